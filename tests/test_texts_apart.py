"""Texts are shuffled as seldom as the results allow: threads, word counts by thread, ingestion, dump parts."""

import json

import pytest
from pyspark.sql import functions as F

from threadlens.operators import terms as E
from threadlens.operators import threads as C
from threadlens.schema import ITEM
from threadlens.sources import sinks as SK
from threadlens.streaming import ingest as IN


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def forest(make_items):
    rows = [dict(id=1, type="story", title="one", text="alpha beta beta"),
            dict(id=2, type="comment", parent=1, text="beta gamma"),
            dict(id=3, type="comment", parent=1, text="hidden", dead=True),
            dict(id=4, type="comment", parent=3, text=""),
            dict(id=5, type="comment", parent=2),
            dict(id=6, type="story", title="two", text="alpha"),
            dict(id=7, type="comment", parent=6, text="delta alpha")]
    return make_items(rows)


def apart(items):
    keyed = items.withColumn("text_key", F.when(F.col("text").isNotNull(), F.col("id") + 100)).drop("text")
    return keyed, items.where("text IS NOT NULL").select((F.col("id") + 100).alias("text_key"), "text")


@pytest.mark.parametrize("walk", [
    lambda i, t: C.comment_corpus(i, texts=t), lambda i, t: C.leaf_corpus(i, texts=t), lambda i, t: C.comment_depth(i, texts=t),
    lambda i, t: C.thread_text(i, "once", texts=t), lambda i, t: C.thread_text(i, "legacy", texts=t), lambda i, t: C.top_comments(i, 0, texts=t)])
def test_texts_attached_last_give_the_same_rows(forest, walk):
    rows = lambda df: sorted(map(str, df.collect()))
    whole = walk(forest, None)
    assert rows(whole) == rows(walk(*apart(forest))) and whole.count() > 0


def test_attached_texts_are_not_shuffled_again(spark, forest):
    its, texts = apart(forest)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.with_text(C.assemble_threads(its, prune=False), its, texts=texts)
        executed = plan_of(out)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the last join is on the key of the text, above every other join and shuffle of the threads
    assert "text_key" in next(line for line in executed.splitlines() if "Join" in line)


@pytest.mark.parametrize("most", [1, 20_000])
def test_words_counted_where_their_thread_is(spark, forest, monkeypatch, most):
    monkeypatch.setattr(E, "MOST_TOGETHER", most)
    rows = C.comment_corpus(forest).select("root_id", "text")
    got = E.term_frequencies_together(rows, "root_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.term_frequencies(rows, ["root_id"]).collect()))
    executed = plan_of(E.term_frequencies_together(rows, "root_id"))[1]
    if most > 1:        # nothing is shuffled after the words are made
        assert "Exchange" not in executed[:executed.index("Generate explode")]


def test_a_batch_without_known_keys_is_not_shuffled(spark, tmp_path):
    store = str(tmp_path / "store")
    IN._ensure_table(spark, store, ITEM)
    row = lambda i, t: tuple({"id": i, "text": t}.get(f.name) for f in ITEM.fields)
    first = spark.createDataFrame([row(i, f"t{i}") for i in range(5)], ITEM)
    fresh = IN._new_rows(first, store, ITEM, "id")
    assert "Exchange" not in plan_of(fresh)[1]
    fresh.write.mode("append").parquet(store)
    again = spark.createDataFrame([row(i, f"t{i}") for i in (3, 4, 5, 5, 6)], ITEM)
    assert sorted(r["id"] for r in IN._new_rows(again, store, ITEM, "id").collect()) == [5, 6]


def test_ranged_store_takes_an_id_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, ids in (("a", [1, 2, 501]), ("b", [2, 501, 1200])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "type": "story"}) for i in ids))
        IN.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), ids_per_part=500)
    got = [r["id"] for r in IN.read_store(spark, str(tmp_path / "s"), ITEM, 500).collect()]
    assert sorted(got) == [1, 2, 501, 1200]


@pytest.mark.parametrize("ids", [list(range(10)), [0, 1, 1, 1, 1, 2, 3], [5, None, 3, 9]])
def test_parts_of_a_dump(spark, tmp_path, ids):
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, type string")
    SK.split_files(df, str(tmp_path / "p"), rows_per_file=3, compression="gzip")
    got = spark.read.schema("id bigint, type string, part int").json(str(tmp_path / "p")).collect()
    sizes = [sum(r["part"] == k for r in got) for k in range(-(-len(ids) // 3))]
    assert sizes == [min(3, len(ids) - 3 * k) for k in range(len(sizes))]
    order = sorted(ids, key=lambda v: (v is not None, v or 0))
    assert [r["id"] for r in sorted(got, key=lambda r: (r["part"], r["id"] is not None, r["id"] or 0))] == order
    assert all(f.suffix == ".gz" for f in (tmp_path / "p").rglob("part-*"))
