"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary word-bigram model are counted over labelled documents. All counts are continuation counts:
after how many different words a word or a pair occurs, so that copies of a text add nothing.
Absolute discounting moves mass from a class's own counts to its backoff: a discount of ``DISCOUNT`` and
``OTHER`` times one more than the count in the other class, scaled to the class's size, and the whole of counts up to ``RARE``. Only
the first of these is Kneser-Ney's; the others are added, since plain models of classes of unequal size mostly tell the sizes apart. Pairs back off to words of the class, words to counts shared by both classes. So what both classes say, and
what is too rare to tell, has the same probability in both. A document's score is a logistic curve over
the difference of its two log-likelihoods per word, fitted on labelled documents that the models have not counted.

Words are counted under hashes and pairs up to ``MOST_PAIRS``, so a model's size is bounded whatever it was trained on.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words
from threadlens.llm.common import arrow_texts, row_blocks, stored

WORD_BITS = 18
DISCOUNT, OTHER, RARE = 0.75, 3.0, 2
#: Most pairs of a model, those with the largest discounted counts.
MOST_PAIRS = 1 << 20
#: Most labelled documents that are counted of each class, and most that the curve is fitted on.
FIT_ROWS = 10_000
CURVE_ROWS = 8_000
#: One training document in so many is left for the curve.
CURVE_SHARE = 5
_U = np.uint64
_BLOCK = 2_000_000


class Model(NamedTuple):
    """What each class (0 ordinary, 1 toxic) keeps after discounting, and the curve's weight and bias."""

    keys: np.ndarray    # pairs that some class keeps, ascending
    pairs: np.ndarray   # 2 x keys: the pair's share of what follows its first word
    rest: np.ndarray    # 2 x words: what is left for the backoff after a word
    single: np.ndarray  # 2 x words: probability of a word
    curve: tuple[float, float]


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Word bucket, buckets of the two words before (0 before a text's start) and row of each word (lower-cased alphanumeric runs)."""
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    word = (words.hashes(words.LOWER[data], starts, ends) >> _U(64 - WORD_BITS)).astype(np.int64)
    before, second = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    if len(word):
        before[1:] = np.where(rows[1:] == rows[:-1], word[:-1], 0)
        second[2:] = np.where(rows[2:] == rows[:-2], word[:-2], 0)
    return word, before, second, rows


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (before << WORD_BITS) | word


def _pairs(rows: DataFrame) -> DataFrame:
    """``toxic, key, n``: the pairs of ``rows`` (``toxic, text``) and after how many different words each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(0).to_pylist(), np.int64)
            data, offsets = arrow_texts(batch.column(1))
            for a, b in row_blocks(offsets, _BLOCK):
                word, before, second, row = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                for c in (0, 1):
                    mine = label[a:b][row] == c
                    key = np.unique((second[mine] << 2 * WORD_BITS) | _pair(before[mine], word[mine]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key)], names=["toxic", "key"])

    triples = rows.mapInArrow(run, "toxic int, key bigint").distinct()
    pair = F.col("key").bitwiseAND(F.lit((1 << 2 * WORD_BITS) - 1))
    return triples.groupBy("toxic", pair.alias("key")).agg(F.count("*").alias("n"))


def own_counts(n: list, totals: list, floor, choose):
    """Discounted counts of both classes from their counts; ``totals`` scale the other class's counts to the own class's size."""
    out = []
    for c in (0, 1):
        left = n[c] - DISCOUNT - OTHER * (totals[c] / max(totals[1 - c], 1)) * (n[1 - c] + 1)
        out.append(choose(n[c] > RARE, floor(left)))
    return out


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by a hash of ``key``; all, if there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) < int(most / n * 1_000_000))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS) -> Model | None:
    """A model of the labelled documents; None if either class has none. Null keys, texts and labels teach nothing.

    A document with several equal labels counts once; one with both is left out.
    """
    known = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where("toxic IN (0, 1)")
             .groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").join(known, "key")
    curve = F.pmod(F.xxhash64("key"), F.lit(CURVE_SHARE)) == 0
    parts = [_bounded(rows.where(~curve & (F.col("toxic") == c)), fit_rows) for c in (0, 1)]
    counts = stored(_pairs(parts[0].unionByName(parts[1]).select("toxic", "text")), "pairs")
    size = 1 << WORD_BITS

    def table(frame: DataFrame) -> np.ndarray:
        got = frame.toPandas()
        out = np.zeros((2, size))
        out[got["toxic"], got["k"]] = got["n"]
        return out

    alone = table(counts.groupBy("toxic", F.col("key").bitwiseAND(F.lit(size - 1)).alias("k")).agg(F.count("*").alias("n")))
    after = table(counts.groupBy("toxic", F.shiftright("key", WORD_BITS).alias("k")).agg(F.sum("n").alias("n")))
    if not alone.sum(axis=1).all():
        return None
    sides = counts.groupBy("key").agg(*(F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    own = own_counts([F.col("n0"), F.col("n1")], after.sum(axis=1).tolist(), lambda x: F.greatest(x, F.lit(0.0)),
                     lambda test, x: F.when(test, x).otherwise(0.0))
    pairs = (sides.select("key", own[0].alias("k0"), own[1].alias("k1")).where("k0 + k1 > 0")
             .orderBy(F.desc(F.col("k0") + F.col("k1")), "key").limit(MOST_PAIRS).toPandas().sort_values("key"))
    model = smoothed(alone, after, pairs["key"].to_numpy(np.int64), pairs[["k0", "k1"]].to_numpy(float).T)
    held = _bounded(rows.where(curve), curve_rows)
    got = compare(held, model, "text").select("toxic", "toxic_margin").where("toxic_margin IS NOT NULL").toPandas()
    return model._replace(curve=_fit(got["toxic_margin"].to_numpy(float), got["toxic"].to_numpy(float)))


def smoothed(alone: np.ndarray, after: np.ndarray, keys: np.ndarray, kept: np.ndarray) -> Model:
    """The model of word counts (2 x words), pairs that follow a word (2 x words), and discounted pair counts (2 x keys)."""
    own = np.stack(own_counts(list(alone), alone.sum(axis=1).tolist(), lambda x: np.maximum(x, 0), lambda test, x: np.where(test, x, 0)))
    shared = (alone - own).sum(axis=0) + 0.5
    total = np.maximum(alone.sum(axis=1, keepdims=True), 1)
    single = own / total + (1 - own.sum(axis=1, keepdims=True) / total) * shared / shared.sum()
    first = keys >> WORD_BITS
    share = kept / np.maximum(after[:, first], 1)
    rest = 1 - np.stack([np.bincount(first, x, alone.shape[1]) for x in share])
    return Model(keys, share, np.maximum(rest, 1e-6), single, (1.0, 0.0))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias of a logistic curve, by Newton steps with a weak prior."""
    if not len(x) or y.min() == y.max():
        return 20.0, 0.0
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        prior = np.array([1e-2, 1e-4])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(prior), a.T @ (y - p) - prior * w)
        w += step / max(1.0, np.abs(step).max() / 2)
    return float(w[0] / scale), float(w[1])


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Toxic minus ordinary log-likelihood per word of each row; NaN without words."""
    n = len(offsets) - 1
    word, before, _, rows = tokens(data, offsets)
    pair = _pair(before, word)
    place = np.minimum(np.searchsorted(model.keys, pair), max(len(model.keys) - 1, 0))
    known = np.flatnonzero(model.keys[place] == pair) if len(model.keys) else np.zeros(0, np.int64)
    logs = []
    for c in (0, 1):
        p = model.rest[c][before] * model.single[c][word]
        p[known] += model.pairs[c][place[known]]
        logs.append(np.log(p))
    count = np.bincount(rows, minlength=n)
    total = np.bincount(rows, logs[1] - logs[0], n)
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def compare(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """``docs`` with ``toxic_margin``, the difference of the two log-likelihoods per word (null without words)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxic_margin")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_texts(batch.column(at).cast(pa.string()))
            parts = [margins(held.value, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                     for a, b in row_blocks(offsets, _BLOCK)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=np.isnan(value))],
                                             names=[*batch.schema.names, "toxic_margin"])

    return docs.mapInArrow(run, docs.withColumn("toxic_margin", F.lit(None).cast("double")).schema)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` added, the probability that a text is toxic (a column of that name is replaced).

    Null, empty and wordless texts have score 0; without a model every score is 0.
    """
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    a, b = model.curve
    return (compare(docs, model, text)
            .withColumn("score", F.coalesce(1 / (1 + F.exp(-(F.lit(a) * F.col("toxic_margin") + b))), F.lit(0.0)))
            .drop("toxic_margin"))
