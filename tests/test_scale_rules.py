"""Caps, scratch folders, rejects and deep or wide threads: what round one got wrong."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadlens.operators import metrics as M
from threadlens.operators import terms as E
from threadlens.operators import threads as C
from threadlens.operators.classify import ml_linear, ml_naive_bayes
from threadlens.operators.embed import subsample
from threadlens.operators.features import to_sparse
from threadlens.session import scratch_base
from threadlens.sources import readers as RD


def test_machine_local_scratch_only_for_local_masters():
    assert scratch_base("local[8]", None) is None and scratch_base("yarn", "hdfs://x/c") == "hdfs://x/c"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch_base(master, None)


def test_no_vocabulary_cap(spark):
    n = 2_100_000   # more than any former bound
    dt = spark.range(n).select(F.lit(1).alias("id"), F.col("id").cast("string").alias("term"), F.lit(1).alias("tf"))
    v = E.vocabulary(dt, n_docs=F.lit(1))
    assert v.agg(F.count("*"), F.countDistinct("term_id"), F.min("term_id"), F.max("term_id")).first()[:] == (n, n, 0, n - 1)
    assert "TakeOrderedAndProject" not in v._jdf.queryExecution().toString()
    for pipeline in (ml_naive_bayes(), ml_linear()):
        assert pipeline.getStages()[1].getVocabSize() == 2 ** 31 - 1


def test_csv_rejects_do_not_depend_on_the_columns_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("1,\xe9t\xe9,5\n2,b,oops\n3,c,7\n".encode("latin-1"))
    schema = StructType([StructField("id", LongType()), StructField("w", StringType()), StructField("n", LongType())])
    good, rejects = RD.read_csv_with_rejects(spark, str(tmp_path), schema)
    assert [r.id for r in good.select("id").orderBy("id").collect()] == [1, 3] and good.count() == 2
    assert sorted(map(tuple, good.collect())) == [(1, "\xe9t\xe9", 5), (3, "c", 7)]
    assert [r[0] for r in rejects.collect()] == ["2,b,oops"]
    store = str(tmp_path / "store")
    for part in (good, good.unionByName(spark.createDataFrame([(9, "z", 1)], schema))):
        RD.append_new(part, store, "id")
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == [1, 3, 9]


def test_crosstab_keeps_rows_without_the_words(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "q"), (None, "y")], "row string, word string")
    assert sorted(map(str, M.crosstab(df, "row", "word", ["x", "y"]).collect())) == sorted(
        map(str, spark.createDataFrame([("a", 2, 0), ("b", 0, 0), (None, 0, 1)], "row string, x long, y long").collect()))
    assert [tuple(r) for r in M.crosstab(df, "row", "word", ["x"], rows=["c", "a"]).orderBy("row").collect()] == [("a", 2), ("c", 0)]


def test_descendants_of_a_chain_a_star_and_a_cycle(spark):
    chain = [(k, k - 1 if k else None) for k in range(150)]
    star = [(1000, None)] + [(1001 + k, 1000) for k in range(10_000)]
    items = spark.createDataFrame(chain + star, "id bigint, parent bigint").withColumn("type", F.lit("comment"))
    got = {r.id: (r.root_id, r.depth, r.descendants) for r in C.descendant_counts(items).collect()}
    assert len(got) == 150 + 10_001
    assert all(got[k] == (0, k, 149 - k) for k in range(150))
    assert got[1000] == (1000, 0, 10_000) and got[5000] == (1000, 1, 0)
    cycle = spark.createDataFrame([(1, None), (2, 3), (3, 2)], "id bigint, parent bigint").withColumn("type", F.lit("story"))
    with pytest.raises(C.ThreadCycleError):
        C.descendant_counts(cycle)


def test_vectors_without_python(spark):
    long = spark.createDataFrame([(1, 5, 2.0), (1, 0, 1.0), (2, 3, 4.0)], "id int, i int, v double")
    got = {r.id: r.features for r in to_sparse(long, "id", "i", "v", 7).collect()}
    assert got[1].toArray().tolist() == [1, 0, 0, 0, 0, 2, 0] and got[2].size == 7 and got[2].indices.tolist() == [3]


def test_subsample_touches_frequent_words_only(spark):
    rows = [("text", k, ["the"] * 40 + [f"w{k}", "the"]) for k in range(200)]
    df = spark.createDataFrame(rows, "kind string, id int, tokens array<string>")
    out = subsample(df, ["kind", "id"], "tokens").collect()
    assert all(f"w{r.id}" in r.tokens for r in out) and len(out) == 200
    left = sum(t == "the" for r in out for t in r.tokens)
    assert 0.01 < left / 8200 < 0.06   # (sqrt(f/sT) + 1) sT/f = 0.0336 of them
    again = subsample(df.repartition(7), ["kind", "id"], "tokens").collect()
    assert sorted((r.id, tuple(r.tokens)) for r in out) == sorted((r.id, tuple(r.tokens)) for r in again)
