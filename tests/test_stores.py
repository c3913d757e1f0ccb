"""Stores partitioned by id, parts of exact size, documents by line, categories and allow-lists."""

import json

import pytest
from pyspark.sql import functions as F

from threadlens.operators import filters as B
from threadlens.operators import threads as C
from threadlens.plans import catalog
from threadlens.schema import ITEM
from threadlens.sources import readers as RD
from threadlens.sources import sinks as SK
from threadlens.streaming import ingest as I

SF = "/root/testdata/sf0.001"


def land(path, name, ids):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps({"id": i, "type": "story", "title": f"t{i}"}) + "\n" for i in ids))


def test_partitioned_store_reads_only_the_ranges_of_a_batch(spark, tmp_path):
    base, store = str(tmp_path), str(tmp_path / "store")
    run = lambda: I.ingest_stream(spark, f"{base}/landing", store, f"{base}/cp", ids_per_part=100)
    land(tmp_path / "landing", "a.json", range(0, 1000))
    run()
    land(tmp_path / "landing", "b.json", [5, 999, 1000, 1001, 1001, 205])        # old ids, new ones and a repeated one
    run()
    run()
    rows = I.read_store(spark, store, ITEM, 100)
    assert sorted(r.id for r in rows.collect()) == list(range(1002))
    assert rows.where(F.col("id_part") != F.floor(F.col("id") / 100)).count() == 0
    fresh = spark.createDataFrame([(5, 0), (1001, 10)], "id long, id_part long")
    new = I.not_held(fresh, store, ITEM, "id", 100)
    assert [r.id for r in new.collect()] == []
    scan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_part" in scan and "IN (0,10)" in scan


def test_process_once_into_a_partitioned_table(spark, tmp_path):
    base, seen = str(tmp_path), []

    def process(stories):
        seen.extend(r.id for r in stories.collect())
        return stories.select("id", F.length("title").alias("n"))

    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string("id long, n int")
    for name, ids in (("a.json", range(0, 30)), ("b.json", range(20, 50))):
        land(tmp_path / "landing", name, ids)
        I.process_new_stories(spark, f"{base}/landing", f"{base}/out", f"{base}/cp", process, schema, ids_per_part=7)
    assert sorted(seen) == list(range(50))
    assert sorted((r.id, r.n) for r in I.read_store(spark, f"{base}/out", schema, 7).collect()) == [(i, len(f"t{i}")) for i in range(50)]


@pytest.mark.parametrize("n", [0, 1, 10, 25])
def test_parts_hold_exactly_n_rows(spark, tmp_path, n):
    df = spark.range(25).select((F.col("id") * 7 % 25).alias("id"), F.lit("x").alias("v")).limit(n)
    SK.split_files(df, str(tmp_path / "p"), rows_per_file=10)
    files = sorted((tmp_path / "p").glob("part=*/*.json"))
    sizes = [len(f.read_text().splitlines()) for f in files]
    ids = [json.loads(line)["id"] for f in files for line in f.read_text().splitlines()]
    assert sizes == [10] * (n // 10) + ([n % 10] if n % 10 else []) and ids == sorted(ids) and len(ids) == n


def test_vocabulary_parts_are_bounded_and_in_order(spark):
    wf = spark.createDataFrame([(i, f"w{k:03}", 1 + k % 4) for i in (1, 2) for k in range(25 if i == 1 else 3)], "id long, word string, freq long")
    stories = spark.createDataFrame([(1, "one"), (2, None)], "id long, title string")
    got = {(r.id, r.part): [(v.word, v.freq) for v in r.vocabulary] for r in SK.nest_vocabulary_parts(wf, stories, 10).collect()}
    whole = {r.id: [(v.word, v.freq) for v in r.vocabulary] for r in SK.nest_vocabulary(wf, stories).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 10, (1, 1): 10, (1, 2): 5, (2, 0): 3}
    assert got[1, 0] + got[1, 1] + got[1, 2] == whole[1] and got[2, 0] == whole[2]


def test_documents_by_line_with_every_kind_of_reject(spark, tmp_path):
    good = {"id": 1, "type": "story", "kids": [{"id": 2, "kids": [{"id": 3, "text": "deep"}, 9, {"no": "id"}]}, {"id": 4, "parent": 1}]}
    lines = [json.dumps(good), json.dumps(good)[:-4], "[1, 2]", "7", "", '{"type": "story"}', '{"id": "x"}', '{"id": 5, "kids": 3, "score": "many"}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    items, rejects = RD.read_thread_json(spark, str(tmp_path), lines=True)
    assert sorted((r.id, r.parent, r.depth, r.text) for r in items.collect()) == [
        (1, None, 0, None), (2, 1, 1, None), (3, 2, 2, "deep"), (4, 1, 1, None), (5, None, 0, None)]
    assert sorted(r.value for r in rejects.collect()) == sorted(x for x in lines[1:7] if x)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.json").write_text("oops\n")
    items, rejects = RD.read_thread_json(spark, str(tmp_path / "none"), lines=True)
    assert items.collect() == [] and rejects.count() == 1
    chain = {"id": 40}
    for i in range(39, 0, -1):
        chain = {"id": i, "kids": [chain]}
    (tmp_path / "chain.json").write_text(json.dumps(chain))
    with pytest.raises(RuntimeError):
        RD.read_thread_json(spark, str(tmp_path / "chain.json"), max_depth=3)


def test_categories(spark, tmp_path):
    df = spark.createDataFrame([("a", f"line {k}") for k in range(400)] + [("b", "x"), ("c", "[deleted]")], "category string, text string")
    SK.write_by_category(df, str(tmp_path / "c"), files=4)
    assert 1 <= len(list((tmp_path / "c" / "category=a").glob("*.txt"))) <= 4 and len(list((tmp_path / "c" / "category=b").glob("*.txt"))) == 1
    assert RD.read_partitioned_text(spark, str(tmp_path / "c")).count() == 402
    allow = spark.createDataFrame([("a",), ("c",), ("a",)], "name string")
    for names in (allow, ["a", "c"]):
        assert B.category_filter(df, names, "category", "text").groupBy().count().first()[0] == 400


def test_settled_threads_of_a_long_chain(spark):
    rows = [(k, k - 1 if k else None, "story" if k == 0 else "comment", None, k == 70) for k in range(100)] + [(200, 999, "story", None, None)]
    items = spark.createDataFrame(rows, "id long, parent long, type string, deleted boolean, dead boolean")
    got = {r.id: (r.root_id, r.depth) for r in C.thread_roots(items).collect()}
    assert got == {k: (0, k) for k in range(70)} | {200: (200, 0)}
    cycle = spark.createDataFrame([(1, 2, "story", None, None), (2, 3, "c", None, None), (3, 1, "c", None, None)], items.schema)
    with pytest.raises(C.ThreadCycleError):
        C.thread_roots(cycle)


def test_linear_classifier_with_hinge_loss(spark):
    rows = catalog.QUERIES["linear_hinge"](spark, SF).toPandas()
    first = rows["label"] == rows["prediction"]
    assert rows["in_top3"].mean() >= first.mean() > 0.9 and (rows["in_top3"] >= first).all() and len(rows) > 20


def test_cluster_words_and_titles(spark):
    rows = catalog.QUERIES["cluster_stories"](spark, SF).collect()
    words, titles = ([r for r in rows if r.kind == k] for k in ("word", "title"))
    assert {r.cluster for r in words} == {r.cluster for r in titles} and len(words) == 8 * len({r.cluster for r in words})
    assert all(r.value for r in rows) and all(1 <= r["rank"] <= (8 if r.kind == "word" else 10) for r in rows)
