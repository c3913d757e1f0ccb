"""What one task holds or reads stays bounded: blocks of similarities, join keys of sentence pieces."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from threadlens.operators import neighbours as NB
from threadlens.operators import sentences as SN


def test_similarities_are_held_in_blocks():
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(1000, 8)), rng.normal(size=(6000, 8))
    tracemalloc.start()
    found = NB._pairs(np.arange(1000), q, np.arange(6000), r, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 5000 and peak < 60e6          # all at once: 48 MB for each of several copies
    sims = np.round(q @ r.T, NB.DIGITS)
    sims[np.arange(1000), np.arange(1000)] = -np.inf
    best = [sorted(range(6000), key=lambda k: (-sims[i, k], k))[:5] for i in (0, 167, 999)]
    assert [found[found["query"] == i]["id"].tolist() for i in (0, 167, 999)] == best


def test_pieces_without_a_period_do_not_share_a_join_key(spark):
    docs = spark.createDataFrame([(i, "the the the the end. The the") for i in range(300)], "doc_id long, text string")
    rows = SN.chunks(docs, ["doc_id"])
    for keys in (["doc_id", "pos"], ["pos", "doc_id"]):
        keyed = rows.where("mark <> '.'").select(SN._dotted(keys, "type").alias("k"))
        assert keyed.where("k IS NULL").count() == 0
        assert keyed.groupBy("k").count().agg(F.max("count")).first()[0] < 20
    assert {r["k"] for r in rows.where("mark = '.'").select(SN._dotted(["doc_id", "pos"], "type").alias("k")).collect()} == {"end"}
