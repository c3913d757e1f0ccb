"""Language identification by mixture inference.

Every language has a distribution over hashed character n-grams (1 to 3 bytes), counted over labelled documents. A text
is cut into short segments; each has a likelihood under each language, and expectation-maximisation
estimates the document's language proportions from them. The set of languages grows one by one, from the best single
language on, as long as the penalised log-likelihood rises.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words
from threadlens.llm.common import arrow_texts, give_back, row_blocks, spare

#: Hash buckets of the n-gram distributions: a model has languages x 65,536 numbers whatever it was trained on.
BITS = 16
#: Bytes of a segment, EM steps, most languages of a document, and the cost of one more language in log-likelihood.
SEGMENT = 48
STEPS = 12
MOST_LANGUAGES = 4
PENALTY = 8.0
#: How far n-grams of a segment count as independent evidence (they overlap threefold).
TEMPER = 1.0 / 3.0
_BLOCK = 2_000_000
UNKNOWN = "und"


def _plain(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes (ASCII, and the capitals of U+00C0-U+00DE); other bytes that are no letters become blanks."""
    out = words.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out = np.where(after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97), out + 0x20, out)
    return np.where((out >= 0x80) | ((out >= 97) & (out <= 122)), out, 32).astype(np.uint32)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Three hash buckets for each byte place: the n-grams of 1, 2 and 3 bytes that end there (within the row)."""
    low = _plain(data)
    one = np.zeros(len(low), np.uint32)
    two = np.zeros(len(low), np.uint32)
    one[1:], two[2:] = low[:-1], low[:-2]
    begin = offsets[:-1][offsets[:-1] < len(low)]
    one[begin] = 32
    two[begin] = 32
    second = begin[begin + 1 < len(low)] + 1
    two[second] = 32
    top = np.uint32(32 - BITS)
    pair = low | (one << np.uint32(8))
    return np.stack([low * np.uint32(0x9E3779B1) >> top, (pair + np.uint32(0x10000)) * np.uint32(0x85EBCA6B) >> top,
                     (pair | (two << np.uint32(16))) * np.uint32(0xC2B2AE35) >> top])


def train(docs: DataFrame, language: str = "lang", text: str = "text", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Learned languages, sorted, and their log distributions (languages x 3 x buckets).

    All rows are counted, so rare languages are learned whole. Rows with a null text or language teach nothing. Without any row there is no language. Counting runs
    per partition on the executors; each partition sends at most languages x 3 x buckets sums.
    """
    labelled = docs.select(F.col(language).cast("string").alias("lang"), F.col(text).cast("string").alias("text")) \
                   .where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data, offsets = arrow_texts(batch.column(1))
            for a, b in row_blocks(offsets, _BLOCK):
                at = offsets[a:b + 1] - offsets[a]
                grams = ngrams(data[offsets[a]:offsets[b]], at)
                for name in set(names[a:b]):
                    mine = np.flatnonzero(names[a:b] == name)
                    own = sums.setdefault(name, np.zeros((3, 1 << BITS), np.int64))
                    for k in range(3):
                        own[k] += np.bincount(np.concatenate([grams[k][at[r]:at[r + 1]] for r in mine]), minlength=1 << BITS)
        rows = [(name, k, int(g), int(own[k][g])) for name, own in sums.items() for k in range(3) for g in np.flatnonzero(own[k])]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["lang", "k", "gram", "n"])

    counted = (labelled.mapInArrow(count, "lang string, k int, gram int, n bigint")
               .groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(counted["lang"].unique())
    table = np.zeros((len(names), 3, 1 << BITS))
    table[[names.index(x) for x in counted["lang"]], counted["k"], counted["gram"]] = counted["n"]
    table += smoothing / 16
    return names, np.log(table / table.sum(axis=2, keepdims=True)).astype(np.float32)


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the segments of all rows, and their rows; every row starts a segment of its own."""
    length = np.diff(offsets)
    each = -(-length // SEGMENT)
    rows = np.repeat(np.arange(len(length)), each)
    first = np.repeat(offsets[:-1], each) + SEGMENT * (np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each))
    return first, rows


def _em(lik: np.ndarray, top: np.ndarray, rows: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the chosen languages (rows x languages, 0 elsewhere) and the log-likelihood of each row."""
    share = chosen / chosen.sum(axis=1, keepdims=True)
    count = np.bincount(rows, minlength=n).astype(float)
    for _ in range(STEPS):
        weight = lik * share[rows]
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.stack([np.bincount(rows, weight[:, j], n) for j in range(lik.shape[1])], 1) / count[:, None]
    return share, np.bincount(rows, np.log((lik * share[rows]).sum(axis=1)) + top, n)


def infer(log_lik: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Proportions (n x languages) from the segments' log-likelihoods; rows without segments have none."""
    langs = log_lik.shape[1]
    out = np.zeros((n, langs))
    if not len(rows):
        return out
    single = np.stack([np.bincount(rows, log_lik[:, j], n) for j in range(langs)], 1)
    best = single.argmax(axis=1)
    seen = np.bincount(rows, minlength=n) > 0
    out[np.flatnonzero(seen), best[seen]] = 1.0
    score = single.max(axis=1)
    # only rows where another language explains some segments better by more than its price can grow
    gain = np.bincount(rows, log_lik.max(axis=1), n) - score
    chosen = out.copy()
    for _ in range(min(MOST_LANGUAGES, langs) - 1):
        open_rows = np.flatnonzero(seen & (gain > PENALTY))
        if not len(open_rows):
            break
        part = np.isin(rows, open_rows)
        place = np.full(n, -1)
        place[open_rows] = np.arange(len(open_rows))
        own = place[rows[part]]
        top = log_lik[part].max(axis=1)
        lik = np.exp(np.maximum(log_lik[part] - top[:, None], -80)).astype(float)
        won = np.zeros(len(open_rows), bool)
        best_score, best_share, best_set = score[open_rows].copy(), out[open_rows].copy(), chosen[open_rows].copy()
        for j in range(langs):
            trial = chosen[open_rows].copy()
            fresh = trial[:, j] == 0
            trial[:, j] = 1
            share, value = _em(lik, top, own, trial, len(open_rows))
            value -= PENALTY * (trial.sum(axis=1) - 1)
            better = fresh & (value > best_score)
            best_score[better], best_share[better], best_set[better] = value[better], share[better], trial[better]
            won |= better
        score[open_rows], out[open_rows], chosen[open_rows] = best_score, best_share, best_set
        gain[:] = 0
        limit = np.bincount(own, top, len(open_rows))
        gain[open_rows] = np.where(won, limit - best_score, 0)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", with_mixture: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added: the language with the largest proportion, and the proportion.

    All rows and other columns stay (those two names are replaced). Texts that are null, empty or without a letter, and all
    texts under a model without languages, are ``und`` with score 0. Ties go to the first name. ``with_mixture`` adds
    ``mixture``, a map of the selected languages' proportions.
    """
    names, table = model
    docs = docs.drop("lang_pred", "score", "mixture")  # the last one is made, and dropped unless it is asked for
    (lettered,) = spare(docs, "lettered")
    state = docs.withColumn(lettered, has_letter(F.col(text).cast("string")))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((names, np.ascontiguousarray(table.transpose(1, 2, 0))))
    schema = state.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "mixture": F.lit(None).cast("map<string,double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        langs, logs = held.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            data, offsets = arrow_texts(column)
            ok = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            shares = np.zeros((len(ok), len(langs)))
            for a, b in row_blocks(offsets, _BLOCK // max(1, len(langs) // 4)):
                if langs and offsets[b] > offsets[a]:
                    at = offsets[a:b + 1] - offsets[a]
                    grams = ngrams(data[offsets[a]:offsets[b]], at)
                    place = logs[0][grams[0]] + logs[1][grams[1]] + logs[2][grams[2]]
                    first, rows = segments(at)
                    shares[a:b] = infer(np.add.reduceat(place, first, axis=0).astype(float) * TEMPER, rows, b - a)
            ok &= shares.sum(axis=1) > 0 if langs else False
            best = shares.argmax(axis=1) if langs else np.zeros(len(ok), int)
            value = np.where(ok, shares.max(axis=1, initial=0), 0.0)
            maps = [[(langs[j], float(s[j])) for j in np.flatnonzero(s)] if o else [] for s, o in zip(shares, ok)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([langs[j] if o else UNKNOWN for j, o in zip(best, ok)]), pa.array(np.clip(value, 0, 1)),
                 pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[*batch.schema.names, "lang_pred", "score", "mixture"])

    return state.mapInArrow(run, schema).drop(lettered, *([] if with_mixture else ["mixture"]))
