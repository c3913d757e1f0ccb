"""The commonest grams are found without making the others."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import terms as E

TEXTS = [(1, "running runs ran happy happy dog happy dog"), (2, "happy dog running rare happily"), (3, "dogs happy odd dog happy dog"), (4, None), (5, ""),
         (6, "single"), (7, "dog happy dog rare one")]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 1000])
def test_same_as_counting_all_grams(spark, n):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    every = E.doc_freq(E.stemmed_grams(docs, ["doc_id"])).select("term", "df", "cf")
    want = every.orderBy(F.col("cf").desc(), "term").limit(n).collect()
    assert [tuple(r) for r in E.top_stemmed_grams(docs, "doc_id", n).collect()] == [tuple(r) for r in want]


def test_rare_grams_are_not_made(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common word common word seldom{chr(97 + k)} odd{chr(97 + k)}") for k in range(20)], "doc_id long, text string")
    kept, count = [], E.doc_freq
    monkeypatch.setattr(E, "doc_freq", lambda df, *a: kept.append(df) or count(df, *a))
    assert E.top_stemmed_grams(docs, "doc_id", 2).count() == 2
    # only grams of the two commonest stems are counted
    assert {w for r in kept[0].select("term").distinct().collect() for w in r["term"].split()} == {"common", "word"}


@pytest.mark.parametrize("n,first", [(1, 1), (2, 1), (2, 3), (3, 2), (5, 4), (4, 2000), (1000, 3)])
def test_top_grams_same_as_counting_all(spark, n, first):
    docs = spark.createDataFrame(TEXTS + [(8, "rare bird rare bird rare bird odd dog")], "doc_id long, text string")
    count = {}
    for r in docs.select(E.default_tokens("text").alias("t")).collect():
        for m in (1, 2, 3):
            for k in range(len(r.t) - m + 1):
                gram = (m, " ".join(r.t[k:k + m]))
                count[gram] = count.get(gram, 0) + 1
    want = [(m, g, c, k + 1) for m in (1, 2, 3) for k, (c, g) in enumerate(sorted(((-c, g) for (o, g), c in count.items() if o == m))[:n])]
    got = E.top_grams(docs, n, first=first).collect()
    assert sorted((r["n"], r["gram"], -r["cnt"], r["rank"]) for r in got) == sorted(want)


def test_top_grams_makes_no_rare_grams(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common word common word seldom{chr(97 + k)} odd{chr(97 + k)}") for k in range(20)], "doc_id long, text string")
    made, make = [], E._grams_of
    monkeypatch.setattr(E, "_grams_of", lambda *a: made.append(make(*a)) or made[-1])
    got = E.top_grams(docs, 1, first=2).collect()
    assert sorted((r["n"], r["gram"], r["cnt"]) for r in got) == [(1, "common", 40), (2, "common word", 40), (3, "common word common", 20)]
    assert len(made) == 2       # a word of the second look must reach 20
    assert all({w for r in grams.collect() for w in r["gram"].split()} == {"common", "word"} for grams in made)
