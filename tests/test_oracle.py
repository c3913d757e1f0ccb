"""Every registered query with a SQL twin equals DuckDB (sf0.001, fast); entry() runs."""

import pytest

import __spark_entry__ as E
from threadlens.plans import catalog
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {"lda_topics", "tag_all_stories", "word2vec_vectors", "word_synonyms", "word_similarity", "kmeans_words",
        "linear_ml", "cluster_terms",
        # checked by their properties in test_stores, test_neighbours and test_topics
        "linear_hinge", "cluster_stories", "nearest_vectors_indexed", "nearest_vectors_recall", "tag_stream"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_duckdb(spark, con, name):
    ok, msg = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE[name], SF)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["root_id", "word", "freq", "rank"]
    assert rows and all(1 <= r["rank"] <= 20 and r["freq"] >= 1 and r["word"] for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - SLOW))
def test_rows_only_queries_run(spark, name):
    rows = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(rows) and rows.notna().all().all()


def test_linear_classifier(spark):
    """Probabilities belong to the best class, and the best three hold the label at least as often as the best one."""
    rows = catalog.QUERIES["linear_ml"](spark, SF).toPandas()
    assert rows["probability"].between(0.25, 1).all()
    first = (rows["label"] == rows["prediction"])
    assert rows["in_top3"].mean() >= first.mean() > 0.9 and (rows["in_top3"] >= first).all()
