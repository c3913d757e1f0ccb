"""Similar documents and nearest vectors against comparing everything with everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import neighbours as NB
from threadlens.operators import similarity as SM
from threadlens.plans import catalog

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- documents
def counts(n, seed):
    """Term counts with frequent and rare terms, many copies of one document, some near copies, and one-term documents."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    docs = {}
    for i in range(n):
        docs[i] = Counter(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(1, 25)))
    base = Counter({f"w{k}": 1 + k % 3 for k in range(20, 40)})
    for i in range(n, n + 40):
        docs[i] = Counter(base)
    for i in range(n + 40, n + 60):
        docs[i] = base + Counter([f"own{i}"])
    return docs


def brute(docs, threshold, k, is_query):
    n, df = len(docs), Counter(t for c in docs.values() for t in c)
    rows = {}
    for i, c in docs.items():
        w = {t: f * (math.log((n + 1) / (df[t] + 1)) + 1) for t, f in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows[i] = {t: x / norm for t, x in w.items()}
    out = []
    for q in (i for i in rows if is_query(i)):
        near = []
        for d in rows:
            if d != q:
                cos = round(sum(x * rows[d].get(t, 0.0) for t, x in rows[q].items()), SM.DIGITS)
                if cos >= threshold:
                    near.append((-cos, d))
        out += [(q, d, round(-c, 6), r) for r, (c, d) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("threshold,k", [(0.3, 10), (0.5, 3), (0.8, 100), (0.99, 10)])
def test_similar_documents_equal_brute_force(spark, threshold, k):
    docs = counts(150, 3)
    dt = spark.createDataFrame([(i, t, f) for i, c in docs.items() for t, f in c.items()], "id bigint, term string, tf bigint")
    index = SM.build_index(dt)
    got = SM.similar_documents(index, F.col("id") % 7 == 0, threshold, k)
    rows = sorted((r.query, r.id, round(r.cosine, 6), r["rank"]) for r in got.collect())
    assert rows == brute(docs, threshold, k, lambda i: i % 7 == 0)


def test_copies_are_one_row_of_the_index_and_common_terms_are_not_posted(spark):
    docs = counts(150, 3)
    dt = spark.createDataFrame([(i, t, f) for i, c in docs.items() for t, f in c.items()], "id bigint, term string, tf bigint")
    index = SM.build_index(dt)
    distinct = len({frozenset(c.items()) for c in docs.values()})
    assert index.rows.select("id").distinct().count() == distinct and index.classes.count() == len(docs)
    pairs = SM.candidates(index, index.rows.select("id").distinct(), 0.8).count()
    assert pairs < 0.25 * distinct * (distinct - 1)
    assert SM.build_index(dt.limit(0)).rows.count() == 0


def test_search_in_many_blocks_keeps_the_best_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(SM, "QUERY_ENTRIES", 40)
    monkeypatch.setattr(SM, "PRODUCTS", 30)     # a few rows at a time, and held rows are cut down often
    docs = counts(150, 3)
    dt = spark.createDataFrame([(i, t, f) for i, c in docs.items() for t, f in c.items()], "id bigint, term string, tf bigint")
    index = SM.build_index(dt)
    reps = index.classes.where("id % 7 = 0").select(F.col("class").alias("id")).distinct()
    found = SM.nearest_rows(index, reps, 0.0, 3)
    assert found.count() <= 3 * reps.count() * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted((r.query, r.id, round(r.cosine, 6), r["rank"]) for r in SM.similar_documents(index, F.col("id") % 7 == 0, 0.3, 4).collect())
    assert rows == brute(docs, 0.3, 4, lambda i: i % 7 == 0)


# ---------------------------------------------------------------- vectors
def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    v = centers[rng.integers(0, 6, n)] + rng.normal(scale=0.7, size=(n, dims))
    v[n // 3:2 * n // 3] = v[0]          # a third of the rows is one vector
    return [(i, [float(x) for x in r]) for i, r in enumerate(v)]


def brute_vectors(rows, k, step):
    ids = np.array([i for i, _ in rows])
    u = np.array([v for _, v in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    out = []
    for a in range(0, len(rows), step):
        cos = np.round(u @ u[a], 9)
        near = sorted((-c, int(i)) for c, i in zip(cos, ids) if i != ids[a])[:k]
        out += [(int(ids[a]), i, r) for r, (_, i) in enumerate(near, 1)]
    return sorted(out)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 5), (9004, [float("nan")] * 5), (9005, [1.0, None, 1.0, 1.0, 1.0]), (9006, [float("inf")] * 5)]


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_and_fully_probed_search(spark, monkeypatch, block):
    monkeypatch.setattr(NB, "QUERY_BLOCK", block)
    monkeypatch.setattr(NB, "CELL_BLOCK", 50 if block == 7 else 4096)
    rows = vectors(300, 5, 1)
    df = NB.unit_vectors(spark.createDataFrame(rows + ODD, "vec_id bigint, embedding array<double>").repartition(3), "vec_id", "embedding")
    assert df.count() == 300
    queries = df.where("id % 20 = 0")
    want = brute_vectors(rows, 10, 20)
    exact = NB.nearest_exact(df, queries, 10)
    assert sorted((r.query, r.id, r["rank"]) for r in exact.collect()) == want
    index = NB.build_index(df)
    probed = NB.nearest_indexed(index, queries, 10, probes=len(index.centroids))
    assert sorted((r.query, r.id, r["rank"]) for r in probed.collect()) == want
    assert NB.recall(probed, exact).first().recall == 1.0


def test_no_vectors(spark):
    df = NB.unit_vectors(spark.createDataFrame(ODD, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    assert NB.nearest_exact(df, df).collect() == [] and NB.nearest_indexed(NB.build_index(df), df).collect() == []


def test_recall_of_the_index(spark):
    got = catalog.QUERIES["nearest_vectors_recall"](spark, SF).first()
    assert got.recall >= 0.9 and got.n == 50


def test_recall_is_measured_and_tuned_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(NB, "sample_n", lambda *a: pytest.fail("a sample was drawn"))
    got = catalog.QUERIES["nearest_vectors_recall"](spark, SF).first()
    rows = NB.unit_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding").count()
    assert got.n == 10 * rows and got.recall >= NB.TARGET_RECALL


def test_probes_are_as_many_as_the_given_neighbours_need(spark, monkeypatch):
    df = NB.unit_vectors(spark.createDataFrame(vectors(300, 5, 1), "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    index = NB.build_index(df, cells=12, fit_on=None)
    exact = NB.nearest_exact(df, df, 10)
    monkeypatch.setattr(NB, "SIMILARITIES", 100)    # a few rows at a time
    rows, cell = {r.id: r.v for r in df.collect()}, {r.id: r.cell for r in index.rows.collect()}
    places = sorted(list(np.argsort(-(index.centroids @ np.array(rows[r.query])), kind="stable")).index(cell[r.id]) for r in exact.collect())
    for target in (0.5, 0.9, 1.0):
        assert NB.tuned_probes(index, target=target, true=exact) == places[math.ceil(target * len(places)) - 1] + 1
