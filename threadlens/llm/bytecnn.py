"""Quality classifier: a small convolutional network over bytes, in numpy.

Bytes are embedded and run through learned filters of 8 bytes at every fourth byte. Filters are max-pooled over blocks of 256
bytes; a chunk is two neighbouring blocks, so chunks overlap by half and cover the whole document. A hidden layer gives
each chunk a logit of low quality, and a document's logit is the logarithm of the mean of its chunks' odds: a
document is as bad as its bad chunks make it, whatever its length.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import arrow_texts, row_blocks

GROUP, BLOCK = 4, 256
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Most labelled documents of each label that a fit reads, and their most bytes together.
FIT_ROWS = 1_500
FIT_BYTES = 24_000_000
STEPS, BATCH, RATE = 1_000, 24, 4e-3
_PART = 400_000

Weights = dict[str, np.ndarray]


def layout(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each row (one at least) and the first block of each row (and their total)."""
    blocks = np.maximum(1, -(-np.diff(offsets) // BLOCK))
    return blocks, np.concatenate([[0], np.cumsum(blocks)])


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of 4 bytes of all rows, each row filled up with zeros to whole blocks, and the groups after them."""
    blocks, first = layout(offsets)
    length = np.diff(offsets)
    buffer = np.zeros(first[-1] * BLOCK, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], length)] = data
    groups = buffer.reshape(-1, GROUP)
    after = np.zeros_like(groups)
    after[:-1] = groups[1:]
    after[first[1:] * (BLOCK // GROUP) - 1] = 0  # no row looks into the next one
    return groups, after


def start(seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    wide = 2 * GROUP * EMBED
    return {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, wide ** -0.5, (wide, FILTERS)),
            "shift": np.zeros(FILTERS), "hidden": rng.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)), "bias": np.zeros(HIDDEN),
            "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "last": np.zeros(1)}


def _pool(w: Weights, groups: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Filter values (blocks x places x filters)."""
    half = GROUP * EMBED
    seen = w["embed"][groups].reshape(-1, half)
    value = seen @ w["filters"][:half]
    next_half = seen @ w["filters"][half:]
    value[:-1] += next_half[1:]
    ends = np.flatnonzero((after == 0).all(axis=1))  # the group after is empty, or belongs to another row
    fix = w["embed"][after[ends]].reshape(-1, half) @ w["filters"][half:]
    inner = ends[ends < len(value) - 1]
    value[inner] += fix[:len(inner)] - next_half[inner + 1]
    if len(ends) and ends[-1] == len(value) - 1:
        value[-1] += fix[-1]
    return value.reshape(-1, BLOCK // GROUP, FILTERS) + w["shift"]


def _chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two blocks of each chunk (the same one twice in a row of one block) and its row."""
    blocks, first = layout(offsets)
    count = np.maximum(1, blocks - 1)
    row = np.repeat(np.arange(len(blocks)), count)
    a = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return a, np.minimum(a + 1, first[row] + blocks[row] - 1), row


def forward(w: Weights, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
    """Logit of low quality of each row; with ``keep`` also what the backward pass needs."""
    groups, after = padded(data, offsets)
    value = _pool(w, groups, after)
    top = value.max(axis=1)
    a, b, row = _chunks(offsets)
    pooled = np.maximum(np.maximum(top[a], top[b]), 0)
    inner = np.tanh(pooled @ w["hidden"] + w["bias"])
    logit = np.clip(inner @ w["out"], -30, 30)
    n = len(offsets) - 1
    odds = np.exp(logit)
    total = np.bincount(row, odds, n)
    out = np.log(total / np.bincount(row, minlength=n)) + w["last"][0]
    return (out, (groups, after, value, top, a, b, row, pooled, inner, odds, total)) if keep else out


def backward(w: Weights, grad: np.ndarray, held) -> Weights:
    """Gradients of the weights for the rows' logit gradients."""
    groups, after, value, top, a, b, row, pooled, inner, odds, total = held
    chunk = grad[row] * odds / total[row]
    g: Weights = {"last": np.array([grad.sum()]), "out": inner.T @ chunk}
    deep = chunk[:, None] * w["out"] * (1 - inner ** 2)
    g["bias"], g["hidden"] = deep.sum(axis=0), pooled.T @ deep
    back = (deep @ w["hidden"].T) * (pooled > 0)
    left = top[a] >= top[b]
    block = np.zeros_like(top)
    np.add.at(block, a, back * left)
    np.add.at(block, b, back * ~left)
    g["shift"] = block.sum(axis=0)
    place = value.argmax(axis=1) + np.arange(len(top))[:, None] * (BLOCK // GROUP)  # of each block and filter
    eight = np.concatenate([groups[place], after[place]], axis=2)                   # blocks x filters x 8 bytes
    seen = w["embed"][eight].reshape(*place.shape, -1)
    g["filters"] = np.einsum("bf,bfk->kf", block, seen)
    spread = (block[:, :, None] * w["filters"].T[None]).reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(eight.ravel(), spread[:, j], 256) for j in range(EMBED)], axis=1)
    return g


def fit(texts: list[bytes], bad: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 11) -> Weights:
    """Train on whole texts by Adam; ``weight`` corrects for the labels' shares in the sample."""
    w = start(seed)
    rng = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(-(-steps // -(-len(texts) // BATCH))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            data, offsets = joined([texts[i] for i in pick])
            out, held = forward(w, data, offsets, keep=True)
            p = 1 / (1 + np.exp(-out))
            g = backward(w, weight[pick] * (p - bad[pick]) / len(pick), held)
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Weights | float:
    """Weights fitted on at most ``fit_rows`` documents of each label, drawn by a hash of their ids; whole texts.

    Texts are taken in the hash's order until ``fit_bytes`` are reached. With documents of one label only, the share of label 1 is
    returned instead (0.5 without any). Null keys, texts and labels teach nothing; a key with both labels is left out.
    """
    known = (labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
             .groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most"))
    ids = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key")).join(known, "key")
    n = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return float(next(iter(n), 0.5))
    pick = [ids.where(F.col("label") == c).select("label", "key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(fit_rows) for c in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    texts, bad, size = [], [], 0
    for r in rows.orderBy("h", "key").select("label", F.col("text").cast("binary").alias("text")).toLocalIterator():
        size += len(r.text)
        if texts and size > fit_bytes:
            break
        texts.append(bytes(r.text))
        bad.append(1 - r.label)
    bad = np.array(bad, float)
    if bad.min() == bad.max():
        return float(1 - bad[0])
    share = n[0] / (n[0] + n[1])
    weight = np.where(bad == 1, share / bad.mean(), (1 - share) / (1 - bad.mean()))
    return fit(texts, bad, weight)


def score(docs: DataFrame, model: Weights | float, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` added, the probability of label 1 (a column of that name is replaced).

    Null and empty texts are scored like a block of zero bytes; every row is scored alone, whatever is next to it.
    """
    docs = docs.drop("score")
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_texts(batch.column(at).cast(pa.string()))
            parts = [forward(held.value, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                     for a, b in row_blocks(offsets, _PART)]
            value = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(value.astype(float))))],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)
