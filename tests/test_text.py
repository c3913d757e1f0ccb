"""Tokenizer, unescape, n-gram and stem rules."""

from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.functions.stem import stem


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_token_rules(spark):
    toks = one(spark, T.tokens, "I've x abc123 " + "a" * 30 + " http Great words, and Café!")
    assert toks == ["great", "words", "café"]


def test_null_text_gives_empty_tokens(spark):
    assert one(spark, T.tokens, None) == []


def test_escape_order(spark):
    assert one(spark, T.tokens_freq, "&quot;word&quot;") == ["word"]
    assert "quot" in one(spark, lambda c: T.tokens_freq(c, legacy_order=True), "&quot;word&quot;")[0]


def test_unescape_single_pass_and_numeric(spark):
    assert one(spark, T.unescape_html, "a &amp;quot; b &copy; &#233; &#x41; &bogus; &") == "a &quot; b © é A &bogus; &"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "t array<string>")
    out = [r["g"] for r in df.select(T.ngrams_range("t", 1, 3).alias("g")).collect()]
    assert out == [["a", "b", "c", "a b", "b c", "a b c"], ["a"]]


def test_clean_line(spark):
    assert one(spark, T.clean_line, "a,b\nc\rd") == "a b c d"


def test_stem_examples(spark):
    df = spark.createDataFrame([(w,) for w in ["caresses", "ponies", "cats", "running", "happiness", "sing"]], "w string")
    got = [r["s"] for r in df.select(stem("w").alias("s")).collect()]
    assert got == ["caress", "poni", "cat", "runn", "happi", "sing"]
