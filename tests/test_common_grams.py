"""Grams for a cut by document frequency: the same rows as from all grams, without making all of them."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadlens.functions.text import tokens
from threadlens.operators import features as FT
from threadlens.operators import terms as E

WORDS = ["walking", "walks", "walked", "river", "rivers", "stone", "moon", "light", "lights"]
TEXTS = [(i // 3, i, " ".join(WORDS[(i * k + i // 7) % 9] for k in range(1, 9)) + f" once{i}") for i in range(60)]


def _all_grams(spark, docs, stemmed):
    if stemmed:
        return E.stemmed_grams(docs, ["root", "id"]).groupBy("root", "term").agg(F.sum("tf").alias("tf"))
    out = defaultdict(Counter)
    for r in docs.select("root", tokens("text").alias("t")).collect():
        for n in (1, 2, 3):
            out[r.root].update(" ".join(r.t[i:i + n]) for i in range(len(r.t) - n + 1))
    return spark.createDataFrame([(k, t, c) for k, own in out.items() for t, c in own.items()], "root long, term string, tf long")


@pytest.mark.parametrize("stemmed, most", [(False, 20_000), (True, 20_000), (False, 3)])
def test_common_grams_give_the_same_weights(spark, monkeypatch, stemmed, most):
    monkeypatch.setattr(E, "MOST_TOGETHER", most)
    more = [(7, 100 + i, "stone river stone") for i in range(3)] + [(50, 200, ""), (51, 201, None), (52, 202, "lonely")]
    docs = spark.createDataFrame(TEXTS + more, "root long, id long, text string")
    every = _all_grams(spark, docs, stemmed)
    grams = E.common_grams(docs, "root", 0.2, stemmed=stemmed)
    assert grams.n == every.select("root").distinct().count() == 21
    cut = dict(min_df=0.2, max_df=0.9, max_features=200_000)
    want = {(r.root, r.term): (r.tf, round(r.weight, 9)) for r in FT.tfidf(every, "root", **cut).collect()}
    got = {(r.root, r.term): (r.tf, round(r.weight, 9)) for r in FT.tfidf(grams.counts, "root", n_docs=grams.n, **cut).collect()}
    assert got == want and any(t.count(" ") == 2 for _, t in want)
    made = {r.term for r in grams.counts.select("term").distinct().collect()}
    assert len(made) < every.select("term").distinct().count() and not [t for t in made if "once" in t or "lonely" in t]
