"""The pipeline on whole small tables: each stage against its operator, and rows of every kind."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import SF
from tests.llm.test_text import brute_classes, brute_flags
from threadlens.llm import encode


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in P.STAGES:
        docs.append(stage(spark, docs[-1], SF).persist())
    yield docs
    for d in docs[1:]:
        d.unpersist()


def test_stages(spark, stages):
    docs, lang, lines, near, clean, packed = stages
    for d in stages[1:5]:
        assert d.columns == docs.columns and d.schema.fieldNames() == docs.schema.fieldNames()
    assert lang.where(~F.col("text").rlike(r"\p{L}")).count() == 0 and lang.count() >= 0.95 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert lines.count() == lang.count() and lines.where("n_chars != length(text)").count() == 0
    texts = [(r.doc_id, r.text) for r in lines.collect()]
    classes = brute_classes(texts)
    kept = {r.doc_id for r in near.collect()}
    assert kept == {k for k, c in classes.items() if k == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in clean.collect()} == {k for k, t in texts if k in kept and not brute_flags(t, items)[4]}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run_equals_stages(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, P.run(spark, SF).select(*cols).collect())) == sorted(map(tuple, stages[-1].select(*cols).collect()))


def test_copies_keep_their_lines(spark):
    own = [f"Menu\nfirst line of {k}\nsecond line of {k}" for k in range(40)]
    copied = "Menu\nalpha beta gamma\ndelta epsilon"
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(own + [copied] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in P.line_dedup(spark, docs, SF).collect()}
    assert got == {k: t.removeprefix("Menu\n") for k, t, *_ in rows}


def test_stages_with_odd_rows_and_columns(spark, clashing, empty):
    for docs in (clashing, empty):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = out.persist()
        P.STAGES[-1][1](spark, docs, SF).collect()


def test_packing_keeps_few_words(spark, monkeypatch):
    asked, make = [], P.packing.pieces
    monkeypatch.setattr(P.packing, "pieces", lambda *a, **kw: asked.append(kw.get("kept")) or make(*a, **kw))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    few = P.pack(spark, docs, SF)
    assert asked == [encode.KEPT_FEW] and encode.KEPT_FEW * 10 <= encode.KEPT
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tiny, many = (make(docs, encode.tokenizer_path("word_bpe_49k.json"), kept=k).select(*cols) for k in (16, encode.KEPT))
    assert sorted(map(tuple, few.select(*cols).collect())) == sorted(map(tuple, tiny.collect())) == sorted(map(tuple, many.collect()))
