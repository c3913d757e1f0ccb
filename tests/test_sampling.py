"""Exact samples and splits cut at the n-th hash key, against sorting the keys."""

import hashlib

import pytest
from pyspark.sql import functions as F

from threadlens.operators import sampling as D


def ranked(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [1, 7, 1234, 4999, 5000, 6000])
def test_sample_is_the_first_n_by_key(spark, n):
    df = spark.range(5000).unionByName(spark.createDataFrame([(None,)], "id bigint"))
    got = [r.id for r in D.sample_n(df, n, 5, small=3).collect()]
    assert got == sorted(ranked(range(5000), 5)[:n])
    if n <= 5000:
        assert got == [r.id for r in D.sample_n(spark.range(5000), n, 5).collect()]     # the ordered limit


def test_no_task_holds_the_sample(spark):
    plan = D.sample_n(spark.range(50_000), 30_000, 1)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Window" not in plan and "Limit" not in plan


@pytest.mark.parametrize("small", [2, 10_000])
def test_split_sizes_by_group(spark, small):
    rows = [(i, f"g{i % 3}" if i % 10 else None) for i in range(2000)] + [(5000, "one"), (5001, "two"), (5002, "two")]
    df = spark.createDataFrame(rows, "id bigint, cat string")
    got = {r.id: (r.cat, r.part) for r in D.split_exact(df, 0.7, 9, "id", ["cat"], small=small).collect()}
    assert len(got) == len(rows)
    for cat in {c for _, c in rows}:
        ids = [i for i, c in rows if c == cat]
        first = set(ranked(ids, 9)[:int(len(ids) * 0.7 + 0.5)])
        assert {i for i in ids if got[i][1] == "train"} == first and all(got[i][0] == cat for i in ids)


def test_split_of_the_whole_and_of_nothing(spark):
    parts = D.split_exact(spark.range(1001), 0.25, 3)
    assert parts.where("part = 'train'").count() == 250 and parts.count() == 1001
    assert D.split_exact(spark.range(0), 0.5).collect() == []
    assert D.split_exact(spark.range(10), 0.0).where("part = 'train'").count() == 0
    assert D.split_exact(spark.createDataFrame([(None,), (1,)], "id int"), 1.0).where(F.col("id").isNull()).first().part == "test"
