"""Naive Bayes counts texts by class at once: no table of documents and terms is written, joined or read again."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import classify as G
from threadlens.operators import terms as E
from threadlens.plans import q_models as Q

SF = "/root/testdata/sf0.001"


def test_fit_on_counts_is_the_fit_on_documents(spark):
    dt = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (3, "c", 1)], "id long, term string, tf long")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "y")], "id long, label string")
    whole = G.nb_fit(dt, labels)
    counts = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("b", "y", 3), ("c", "x", 1)], "term string, label string, n long")
    short = G.nb_fit_counts(counts, labels)
    assert (whole.classes, whole.prior, whole.logden) == (short.classes, short.prior, short.logden)
    assert sorted(map(tuple, whole.table.collect())) == sorted(map(tuple, short.table.collect()))
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")       # 4 has no term: it gets the prior alone
    got = {r["id"]: r["prediction"] for r in G.nb_score(short, dt, ids=ids).collect()}
    assert got == {1: "x", 2: "y", 3: "x", 4: "x"}


@pytest.mark.parametrize("name", ["nb_predict", "accuracy", "top3_accuracy", "confusion_matrix"])
def test_no_table_of_documents_and_terms(spark, monkeypatch, name):
    written = []
    store = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name="table", **kw: written.append(name) or store(df, name, **kw))
    assert getattr(Q, name)(spark, SF).count() > 0 and "doc_terms" not in written


def test_terms_carry_columns_of_their_document(spark):
    docs = spark.createDataFrame([(1, "p", "alpha beta alpha"), (1, "p", "beta"), (2, "q", "gamma"), (3, "q", None)],
                                 "doc_id long, part string, text string")
    got = E.term_frequencies_together(docs, "doc_id", carry=["part"])
    assert sorted(map(tuple, got.collect())) == [(1, "p", "alpha", 2), (1, "p", "beta", 2), (2, "q", "gamma", 1)]


def test_nb_ml_makes_vectors_once(spark, monkeypatch):
    calls, make = [], G.feature_vectors
    monkeypatch.setattr(G, "feature_vectors", lambda *a, **kw: calls.append(1) or make(*a, **kw))
    got = Q.nb_ml(spark, SF)
    want = Q.nb_predict(spark, SF)
    # one pass for both parts, and the predictions of the relational form (empirical priors)
    assert got.count() == want.count() and len(calls) == 1
    same = got.join(want.select("doc_id", F.col("prediction").alias("p")), "doc_id").where("prediction = p").count()
    assert same >= 0.95 * got.count()


def test_categories_write_no_table_of_comments_and_grams(spark, monkeypatch):
    written, store = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name="table", **kw: written.append((name, df.columns)) or store(df, name, **kw))
    assert Q.category_top3_accuracy(spark, SF).count() == 1
    assert written and not any("term" in columns for _, columns in written)
