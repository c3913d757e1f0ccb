"""Centroid clustering, exact deduplication and whitening against brute force."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from tests.oracle_compare import compare, duck
from threadlens.llm import exactdedup, laesa, queries, whitening


@pytest.mark.parametrize("name", ["op11_laesa", "op12_exact_dedup"])
def test_sql(spark, name):
    ok, message = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, message


# ---------------------------------------------------------------- exact deduplication
def brute_groups(rows):
    groups = defaultdict(list)
    for k, (i, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), i is None, i or 0, k))
    out = {}
    for body, members in groups.items():
        keep = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], rows[keep[3]][0], len(members), hashlib.sha256(body.encode()).hexdigest())
    return out


def first_bit(col):
    """A hash with many collisions: 1 bit."""
    return F.when(F.md5(col) < "8", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))


@pytest.mark.parametrize("hashed", [exactdedup.hash128, first_bit, lambda c: F.unhex(F.lit("00"))])
def test_classes_of_odd_rows(spark, odd_rows, clashing, hashed):
    rows = [(r[0], r[1]) for r in odd_rows]
    want = sorted(map(repr, brute_groups(rows).values()))
    got = exactdedup.classes(clashing, content_hash=hashed).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == {w[3]: 1 for w in brute_groups(rows).values()}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exactdedup.deduplicate(clashing, content_hash=hashed)
    assert left.columns == clashing.columns and left.count() == len({r.text_sha256 for r in got})
    kept = {(r.doc_id, r.text_sha256) for r in got if r.kept}
    assert {(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", r.text or "").encode()).hexdigest()) for r in left.collect()} == kept


def test_hot_group_and_empty(spark, empty):
    rows = [(k, "same text" + " " * (k % 3) if k % 3 else f"text {k}") for k in range(6000)] + [(9000 + k, "\t" * (k + 1)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.classes(docs).collect()}
    want = brute_groups(rows)
    assert got == {w[0]: (w[1], w[2], w[0] == w[1]) for w in want.values()} and got[1][:2] == (2, 4000) and got[9000][0] == 9039
    assert exactdedup.classes(empty).collect() == [] and exactdedup.deduplicate(empty).columns == empty.columns


# ---------------------------------------------------------------- LAESA
VECTORS = st.integers(1, 40).flatmap(lambda n: st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=n, max_size=n))


@settings(max_examples=150, deadline=None)
@given(x=VECTORS, cents=VECTORS, pivots=VECTORS)
def test_nearest_equals_brute_force(x, cents, pivots):
    x, cents, pivots = (np.array(a, np.int64) for a in (x, cents, pivots))
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    cluster, best, exact = laesa.nearest(x, laesa.pivot_distances(x, pivots), cents, pivots)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and exact <= d.size


def test_bounds_rule_out_most_centroids():
    rng = np.random.default_rng(1)
    cents = rng.integers(-1000, 1000, (50, 64))
    x = cents[rng.integers(0, 50, 4000)] + rng.integers(-20, 20, (4000, 64))
    pivots = laesa.choose_pivots(x[:256])
    assert len({tuple(p) for p in pivots.tolist()}) == laesa.PIVOTS
    _, _, exact = laesa.nearest(x, laesa.pivot_distances(x, pivots), cents, pivots)
    assert exact < 0.1 * len(x) * len(cents)


def brute_clusters(rows, dims, scale, clusters, rounds):
    kept = [(i, [math.floor(c * scale) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in seeds[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[1]].append(x)
        cents = [[sum(col) // len(members[k]) for col in zip(*members[k])] if members[k] else c for k, c in enumerate(cents)]
    placed = [(i, *near(x)[::-1]) for i, x in kept]
    total = Counter()
    for _, c, d in placed:
        total[c] += d
    sha = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return [(i, c, d, total[c], sum(total.values()), sha(c)) for i, c, d in placed]


ODD_VECTORS = [(0, [0.5, -1.0, 0.25]), (1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]),
               (5, [1.0, 2.0]), (6, []), (None, [0.1, 0.2, 0.3]), (7, [-0.7, 0.01, 9.0]), (7, [-0.7, 0.01, 9.0]), (8, [0.5, -1.0, 0.25]),
               (9, [3.0, 3.0, -3.0]), (10, [0.0, 0.0, 0.0]), (11, [0.9, -1.2, 0.3]), (7, [5.0, 5.0, 5.0])]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id bigint, embedding array<double>")
    return df.select("*", *(F.lit("x").alias(c) for c in ("id", "x", "pd", "cluster", "distance", "uid", "at", "n", "component", "whitened")))


@pytest.mark.parametrize("clusters", [1, 4, 50])
def test_clusters_of_odd_vectors(odd_vectors, clusters):
    got = laesa.cluster(odd_vectors, dims=3, scale=64, clusters=clusters, rounds=3)
    want = brute_clusters(ODD_VECTORS, 3, 64, clusters, 3)
    rows = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_no_vectors(spark, odd_vectors):
    for df in (odd_vectors.limit(0), odd_vectors.where("vec_id IN (1, 3)")):
        assert laesa.cluster(df, dims=3).collect() == [] and whitening.whiten(df).collect() == []
    assert whitening.whiten(odd_vectors.where("vec_id = 10")).collect() == []       # nothing varies
    far = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        laesa.cluster(far, dims=2).collect()


# ---------------------------------------------------------------- whitening
def check_white(rows, kept, components):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(r, sums))) for (i, _), r in zip(kept, x))
    for k in range(1, components + 1):
        own = [r for r in rows if r.component == k]
        assert Counter((r.vec_id, int(r.deviation)) for r in own) == want and all(r.n == n for r in own)
        z = centred @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        got = sorted((repr(r.vec_id), r.whitened) for r in own)
        same = lambda sign: np.allclose([g[1] for g in got], [w[1] for w in sorted((repr(i), sign * v) for (i, _), v in zip(kept, z))], atol=1e-6)
        assert same(1) or same(-1)
        assert all(abs(r.explained - values[k - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6 for r in own)
    assert len(rows) == components * n


def test_whitening_of_odd_vectors(odd_vectors):
    kept = [(i, v) for i, v in ODD_VECTORS if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    check_white(whitening.whiten(odd_vectors).collect(), kept, 3)
    check_white(whitening.whiten(odd_vectors, components=2).collect(), kept, 2)


def test_whitening_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept = [(r.vec_id, r.embedding) for r in emb.collect()]
    check_white(whitening.whiten(emb.repartition(5)).collect(), kept, 8)


def test_whitening_drops_flat_directions(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 20


def test_whitening_holds_the_matrix_it_reads(odd_vectors, monkeypatch):
    call = whitening.callMLlibFunc

    def late(name, *args):
        if name == "getIndexedRows":
            time.sleep(3)       # a matrix that nothing holds is gone from the JVM by now
        return call(name, *args)

    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    assert whitening.whiten(odd_vectors).count() > 0
