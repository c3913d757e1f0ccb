"""Property checks over the driver tables."""

from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import metrics as M
from threadlens.operators import sampling as D
from threadlens.operators import terms as E
from threadlens.sources.tables import load

SF = "/root/testdata/sf0.001"


def test_word_freq_sums_to_token_count(spark):
    docs = load(spark, SF, "documents")
    total = docs.select(F.sum(F.size(T.tokens("text")))).first()[0]
    wf = E.word_freq(docs, ["doc_id"])
    assert wf.agg(F.sum("freq")).first()[0] == total


def test_balanced_sample_exact_per_class(spark):
    docs = load(spark, SF, "documents")
    smallest = M.min_category(docs, "lang").first()["n"]
    s = D.balanced_sample(docs, "lang", smallest, 7, "doc_id")
    assert {r["n"] for r in s.groupBy("lang").count().withColumnRenamed("count", "n").collect()} == {smallest}


def test_balanced_sample_short_class_raises(spark):
    import pytest
    docs = load(spark, SF, "documents")
    with pytest.raises(ValueError):
        D.balanced_sample(docs, "lang", 10_000, 7, "doc_id")


def test_split_is_disjoint_and_total(spark):
    docs = load(spark, SF, "documents")
    train, test = D.train_test(docs, 0.7, 42, "doc_id")
    assert train.count() + test.count() == docs.count()
    assert train.join(test, "doc_id").count() == 0


def test_confusion_rows_sum_to_one(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    m = M.confusion_matrix(df)
    sums = {r["label"]: r["s"] for r in m.groupBy("label").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-9 for v in sums.values())


def test_vocabulary_drop_top_n(spark):
    dt = E.term_frequencies(load(spark, SF, "documents"), ["doc_id"])
    full = E.vocabulary(dt, id_col="doc_id")
    cut = E.vocabulary(dt, id_col="doc_id", drop_top_n=5)
    assert full.count() - cut.count() == 5
    assert cut.agg(F.min("term_id")).first()[0] == 0
