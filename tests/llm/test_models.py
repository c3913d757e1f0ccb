"""Language ID, context trees, quality and toxicity: exact parts by brute force, the rest by held-out data."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from threadlens.llm import bytecnn, ctw, langid, queries, toxicity, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_words_and_hashes():
    texts = ["ab c", "", "ab", "c", " é ab"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert found == ["ab", "c", "ab", "c", "é", "ab"] and rows.tolist() == [0, 0, 2, 3, 4, 4]
    h = words.hashes(data, starts, ends)
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_languages(spark, tables, odd, clashing, empty, odd_rows):
    out = queries.op5_language_mixture(spark, SF).join(tables["documents"].select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()
    model = langid.train(tables["documents"])
    both = spark.createDataFrame([(1, "Der die und das ist nicht ein haus von dem mann und der frau. " * 4 + "The and of that the with this are was for it as on is. " * 4)],
                                 "doc_id int, text string")
    row = langid.identify(both, model, with_mixture=True).first()
    assert set(row.mixture) >= {"de", "en"} and abs(sum(row.mixture.values()) - 1) < 1e-6 and row.mixture["de"] > 0.2
    got = {(r.doc_id, r.text): r for r in langid.identify(clashing, model).collect()}
    for doc_id, text in [(2, None), (3, ""), (4, " \t\n \x0b"), (9, "12 34 !! ??")]:
        assert (got[doc_id, text].lang_pred, got[doc_id, text].score) == ("und", 0.0)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """A language of one document among very many others, and documents without an id."""
    rare = spark.createDataFrame([(None if k % 8 == 7 else 100_000 + k, f"{w} {w}", f"x{k:02}") for k, w in enumerate("qua zem vor lut hib pax".split() * 4)],
                                 "doc_id bigint, text string, lang string")
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'the one and the other' AS text", "'en' AS lang").unionByName(rare)
    names, table = langid.train(docs)
    assert names == ["en", *(f"x{k:02}" for k in range(24))] and table.shape == (25, 3, 1 << langid.BITS)


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(0)
    rows = np.repeat([0, 1], 400)
    truth = np.where(np.arange(800) % 4 == 0, 1, 0)
    truth[400:] = 2
    lik = rng.normal(-40, 1, (800, 4))
    lik[np.arange(800), truth] += 9
    share = langid.infer(lik, rows, 3)
    assert np.allclose(share[0], [0.75, 0.25, 0, 0], atol=0.03) and share[1].tolist() == [0, 0, 1, 0] and share[2].sum() == 0


def recursive_tree(counts, depth):
    """log2 weighted probability of each node and the predictions, straight from the definition."""
    def kt(n0, n1):
        p = 0.0
        for n in (n0, n1):
            p += math.lgamma(n + 0.5)
        return p - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def bits(c, lo, hi):
        mid = (lo + hi) // 2
        return sum(c[lo:mid]), sum(c[mid:hi])

    def weighted(node, lo, hi):  # node: (counts, children, leaf)
        c, children, leaf = node
        own = kt(*bits(c, lo, hi))
        if leaf:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(weighted(ch, lo, hi) for ch in children))

    def predict(path, byte):
        total = 0.0
        lo, hi = 0, 256
        for _ in range(8):
            p, left = 0.0, 1.0
            for node in path:
                n0, n1 = bits(node[0], lo, hi)
                stop = 1.0 if node[2] else math.exp(math.log(0.5) + kt(n0, n1) - weighted(node, lo, hi))
                p += left * stop * (n1 + 0.5) / (n0 + n1 + 1)
                left *= 1 - stop
            mid = (lo + hi) // 2
            total += math.log10(p if byte >= mid else 1 - p)
            lo, hi = (mid, hi) if byte >= mid else (lo, mid)
        return total

    return predict


def test_context_tree_equals_the_definition():
    counts = np.zeros((3, 256))
    counts[0, [97, 98, 99]] = [6, 3, 1]
    counts[1, [97, 98]] = [4, 1]   # after one byte
    counts[2, [98]] = [2]          # after another
    table = ctw.weigh(counts, np.array([0, 1, 1]), np.array([-1, 0, 0]), np.arange(256))
    assert np.allclose(table, ctw.weigh(counts[:, 97:100], np.array([0, 1, 1]), np.array([-1, 0, 0]), np.arange(97, 100)))
    other = counts[0] - counts[1] - counts[2]
    leaf = lambda c: (list(c), [], True)
    one = lambda c: (list(c), [leaf(c)], False)  # noqa: E731  all that follows such a context is one more leaf
    root = (list(counts[0]), [one(counts[1]), one(counts[2]), leaf(other)], False)
    predict = recursive_tree(counts, 2)
    for byte in (97, 98, 99, 200):
        assert abs(table[0, byte] - predict([root, leaf(other)], byte)) < 1e-5
        assert abs(table[1, byte] - predict([root, one(counts[1]), leaf(counts[1])], byte)) < 1e-5
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_whole_context_tree(spark, monkeypatch):
    """Every context counts, however many there are: against a tree of all contexts held in memory, for known and unknown text."""
    rows = [(k, prose(40, k) + f" q{k}x") for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    texts = docs.where("doc_id < 30 OR doc_id > 59")
    small = ctw.score(docs, ctw.train(texts, nodes=500)).toPandas().sort_values("doc_id")
    held = ctw.score(docs, ctw.train(texts, nodes=1 << 30)).toPandas().sort_values("doc_id")
    model = ctw.train(texts)
    whole = ctw.score(docs, model).toPandas().sort_values("doc_id")
    assert np.allclose(whole.score, held.score, atol=1e-3) and not np.allclose(whole.score, small.score, atol=1e-3)
    deepest = {(r.key >> 8) for r in model[0].grams.collect()}
    assert model[0].levels[ctw.DEPTH].select(F.shiftright("node", 8)).distinct().count() == len(deepest) > 500
    monkeypatch.setattr(ctw, "HOT_GRAMS", 100)  # nearly all grams are met in the join
    assert np.allclose(ctw.score(docs, model).toPandas().sort_values("doc_id").score, whole.score)


def test_language_model_scores(spark, odd, odd_rows, empty):
    train = odd.where("doc_id < 8")
    got = ctw.score(odd.select("doc_id", "text", F.lit("x").alias("score"), F.lit("y").alias("n_bytes")), ctw.train(train, nodes=300)).collect()
    low = {c: c + 32 for c in range(65, 91)}
    split = lambda t: re.findall("[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]
    counts = pd.Series([str(w) for r in odd_rows if r[0] is not None and r[0] < 8 for w in split(r[1])]).value_counts()
    n, v = counts.sum(), len(counts)
    want = sorted((len(split(r[1])), sum(str(w) in counts for w in split(r[1])),
                   round(sum(math.log10((counts.get(str(w), 0) + 1) / (n + v + 1)) for w in split(r[1])), 5)) for r in odd_rows)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert ctw.score(empty.select("doc_id", "text"), ctw.train(train)).count() == 0
    row = ctw.score(odd.select("doc_id", "text"), ctw.train(empty)).first()
    assert row.train_tokens == 0 and row.base_score == 0


def test_rare_words_meet_their_counts(spark, odd, monkeypatch):
    whole = ctw.score(odd.select("doc_id", "text"), ctw.train(odd)).toPandas()
    monkeypatch.setattr(ctw, "HOT", 8)  # nearly all words are rare
    joined = ctw.score(odd.select("doc_id", "text"), ctw.train(odd)).toPandas()
    for c in ("n_known", "base_score"):
        assert np.allclose(np.sort(whole[c]), np.sort(joined[c]))


def test_gradients():
    texts = [b"hello there world " * 30, b"", b"abc", b"x" * 700]
    data, offsets = bytecnn.joined(texts)
    w, rng = bytecnn.start(), np.random.default_rng(0)
    out, held = bytecnn.forward(w, data, offsets, keep=True)
    up = rng.normal(size=4)
    g = bytecnn.backward(w, up, held)
    for k in w:
        at = (ord("e"), 2) if k == "embed" else tuple(rng.integers(0, s) for s in w[k].shape)
        moved = {n: v.copy() for n, v in w.items()}
        moved[k][at] += 1e-6
        assert abs(up @ (bytecnn.forward(moved, data, offsets) - out) / 1e-6 - g[k][at]) < 1e-4
    for j, t in enumerate(texts):  # a row's score does not depend on its neighbours
        assert abs(bytecnn.forward(w, *bytecnn.joined([t]))[0] - out[j]) < 1e-9


def held_out_labels(out, tables, label):
    both = out.join(tables["labels"].select("doc_id", label), "doc_id").where("held_out").toPandas()
    assert both.score.between(0, 1).all()
    return both


def test_quality(spark, tables, clashing, empty, odd, odd_rows):
    both = held_out_labels(queries.op8_byte_cnn(spark, SF), tables, "quality")
    assert (both.predicted == both.quality).mean() > 0.9
    model = bytecnn.train(odd, spark.createDataFrame([(1, 1), (7, 0), (None, 0), (8, None), (5, 1), (5, 0)], "doc_id bigint, quality int"))
    out = bytecnn.score(clashing, model)
    assert out.count() == len(odd_rows) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert bytecnn.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert bytecnn.train(odd, none) == 0.5 and bytecnn.score(odd, 0.5).where("score = 0.5").count() == len(odd_rows)


def test_toxicity(spark, tables, clashing, empty, odd, odd_rows):
    both = held_out_labels(queries.op9_kneser_ney(spark, SF), tables, "toxic")
    assert (both.predicted == both.toxic).mean() > 0.93 and both[both.predicted == 1].toxic.mean() > 0.9
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 0), (8, None), (5, 1), (5, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score(clashing, model)
    assert out.count() == len(odd_rows) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(odd, labels.where("toxic = 0")) is None and toxicity.train(empty, labels) is None
    assert toxicity.score(odd, None).where("score = 0").count() == len(odd_rows)


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    size = 1 << toxicity.WORD_BITS
    alone = np.zeros((2, size))
    alone[:, :50] = rng.integers(0, 30, (2, 50))
    after = np.zeros((2, size))
    after[:, 3] = 40
    keys, kept = toxicity._pair(np.full(5, 3), np.arange(5)), rng.uniform(0, 5, (2, 5))
    model = toxicity.smoothed(alone, after, keys, kept)
    assert np.allclose(model.single.sum(axis=1), 1)
    for c in (0, 1):
        assert abs((model.rest[c][3] * model.single[c]).sum() + model.pairs[c].sum() - 1) < 1e-9


def test_the_other_class_is_scaled_to_the_own_size():
    """A word that is 100 times as likely in the smaller class counts there, and in the larger one does not."""
    own = toxicity.own_counts([np.array([10.0]), np.array([30.0])], [33.0, 1.0], lambda x: np.maximum(x, 0), lambda test, x: np.where(test, x, 0))
    assert own[0][0] == 0 and own[1][0] > 25


def test_held_out(spark):
    from threadlens.llm.common import held_out

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out(5, 0)).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert prose(3, 1) == prose(3, 1)
