"""Language-model scores by context-tree weighting over bytes.

A text is the byte string of its lower-cased words, each with a blank after it, and a line end. Every byte is eight binary
decisions; each decision, in the context of the bytes before it (up to ``DEPTH`` of them) and of the bits already
known, has a Krichevsky-Trofimov estimate. The weighted probability of a node is half its own estimate and half
the product of the nodes one byte deeper, so the prediction mixes the estimates of all depths by how well they have
coded the training text.

The tree has every context of the whole training text, so it grows with the corpus: it is a table for each depth, weighed
bottom-up by one grouping a depth and asked top-down by one join a depth. The log-probabilities of the most frequent
grams (a byte after its context) are looked up in the worker, all others meet theirs in a join. A smaller tree of a given
number of contexts, held whole by the workers, can be asked for; there, what follows a context after a byte that the
tree does not have is one more leaf below it.
"""

from __future__ import annotations

import math
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import words
from threadlens.llm.common import arrow_texts, row_blocks, spare, stored

DEPTH = 6
#: Words with at least 1 in ``HOT`` of all training tokens are looked up in the worker (at most ``HOT`` of them exist).
HOT = 1 << 21
#: The same for grams: those with at least 1 in ``HOT_GRAMS`` of all training bytes are looked up in the worker.
HOT_GRAMS = 1 << 21
END = 10
_U = np.uint64
_BLOCK = 600_000
#: Distinct values that a task gathers before it hands them on.
_HELD = 500_000


class Stream:
    """The byte strings of many texts one after another, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        starts, ends, rows = words.spans(data, offsets, words.NOT_SPACE)
        low = words.LOWER[data]
        self.hash = words.hashes(low, starts, ends).view(np.int64)
        self.rows, self.n_words = rows, np.bincount(rows, minlength=n)
        size = ends - starts
        self.length = np.bincount(rows, size, n).astype(np.int64) + self.n_words + 1
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.full(self.start[-1], 32, np.uint8)
        inside = words.NOT_SPACE[data]
        self.bytes[np.arange(inside.sum()) + np.repeat(np.arange(len(size)) + rows, size)] = low[inside]
        self.bytes[self.start[1:] - 1] = END

    def before(self, depth: int) -> Iterator[np.ndarray]:
        """The byte 1, 2, ... ``depth`` places before each byte; before a text's start there are line ends."""
        place = np.arange(len(self.bytes)) - np.repeat(self.start[:-1], self.length)
        for j in range(1, depth + 1):
            out = np.full(len(self.bytes), END, np.uint8)
            out[j:] = np.where(place[j:] >= j, self.bytes[:-j], END)
            yield out


def _gather(texts: DataFrame, values, kind: str) -> DataFrame:
    """``key, n``: how often each value of ``values(stream)`` (64-bit numbers) occurs in all ``texts`` (one column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge():
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[:] = [(keys[first], np.add.reduceat(counts[order], first))]

        def give():
            keys, counts = held.pop()
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + 100_000]), pa.array(counts[k:k + 100_000])], names=["key", "n"])

        for batch in batches:
            data, offsets = arrow_texts(batch.column(0))
            for a, b in row_blocks(offsets, _BLOCK):
                held.append(np.unique(values(Stream(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])), return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * _HELD:
                    merge()
                    if len(held[0][0]) > _HELD:
                        yield from give()
        if held:
            merge()
            yield from give()

    return stored(texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), kind)


def _grams(stream: Stream) -> np.ndarray:
    """The ``DEPTH`` bytes before each byte, the nearest lowest, above the byte itself."""
    out = stream.bytes.astype(np.int64)
    for j, byte in enumerate(stream.before(DEPTH), 1):
        out |= byte.astype(np.int64) << (8 * j)
    return out


def _tokens(stream: Stream) -> np.ndarray:
    """Hashes of the words, and 0 for each text's end."""
    return np.concatenate([stream.hash, np.zeros(len(stream.length), np.int64)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5 (Stirling's series from 8 on)."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] += np.log(x[small])
        x[small] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def weigh(counts: np.ndarray, depth: np.ndarray, parent: np.ndarray, used: np.ndarray) -> np.ndarray:
    """log10 probabilities (contexts x 256) from counts of the next byte (contexts x ``used``, ascending byte values).

    Contexts are ordered by depth; ``parent`` is the place of the context one byte shorter (-1 for the root).
    A row holds for the texts whose longest context in the tree is that one.
    """
    size, deepest = len(counts), int(depth.max())
    other = counts.copy()  # what follows the context after a byte that the tree does not have
    np.subtract.at(other, parent[1:], counts[1:])
    sums = []
    for c in (counts, other):
        sums.append(np.zeros((size, len(used) + 1)))
        np.cumsum(c, axis=1, out=sums[-1][:, 1:])
    del other
    open_ = depth < DEPTH
    levels = [np.arange(*np.searchsorted(depth, (d, d + 1))) for d in range(deepest + 1)]
    out = np.zeros((size, 256), np.float32)
    for bit in range(8):
        width = 1 << bit
        for lo in range(0, width, 16):  # columns of 16 nodes at a time
            hi = min(width, lo + 16)
            # a node stands for 256 / width byte values; the lower half of them has bit 0
            edge = np.searchsorted(used, np.arange(2 * lo, 2 * hi + 1) * (128 // width))
            below, mid, above = edge[:-2:2], edge[1:-1:2], edge[2::2]
            n0, n1 = sums[0][:, mid] - sums[0][:, below], sums[0][:, above] - sums[0][:, mid]
            o0, o1 = sums[1][:, mid] - sums[1][:, below], sums[1][:, above] - sums[1][:, mid]
            own, rest = _log_kt(n0, n1), np.where(open_[:, None], _log_kt(o0, o1), 0.0)
            weighted = own.copy()
            deeper = rest  # logarithm of the product of the nodes one byte deeper
            for d in range(deepest, -1, -1):
                at = levels[d]
                if d < DEPTH:
                    weighted[at] = np.logaddexp(own[at], deeper[at]) - math.log(2)
                if d:
                    np.add.at(deeper, parent[at], weighted[at])
            stop = np.where(open_[:, None], np.exp(own - math.log(2) - weighted), 1.0)
            ones = (n1 + 0.5) / (n0 + n1 + 1)
            done, left = np.zeros_like(own), np.ones_like(own)
            for d, at in enumerate(levels):
                if d:
                    done[at], left[at] = done[parent[at]], left[parent[at]]
                done[at] += left[at] * stop[at] * ones[at]
                left[at] *= 1 - stop[at]
            one = done + np.where(open_[:, None], left * (o1 + 0.5) / (o0 + o1 + 1), 0.0)
            both = np.stack([np.log10(1 - one), np.log10(one)], axis=2).astype(np.float32)
            span = out.reshape(size, width, 2, 128 // width)
            span[:, lo:hi] += both[:, :, :, None]
    return out


class Tree:
    """Contexts of the tree under a hash table, and the log-probabilities of the byte after each."""

    def __init__(self, keys: np.ndarray, table: np.ndarray):
        self.table = table
        bits = max(10, int(len(keys) * 8 - 1).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, _U), np.zeros(1 << bits, np.int32)
        for k, key in enumerate(keys[1:].astype(_U).tolist(), 1):
            h = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> int(self.shift)
            while self.at[h]:
                h = (h + 1) & self.mask
            self.keys[h], self.at[h] = key, k

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each context, 0 if the tree does not have it."""
        h = ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        at, same = self.at[h], self.keys[h] == keys
        out = np.where(same, at, 0)
        seek = np.flatnonzero((at > 0) & ~same)
        while len(seek):
            h[seek] = (h[seek] + 1) & self.mask
            same = self.keys[h[seek]] == keys[seek]
            out[seek[same]] = self.at[h[seek[same]]]
            seek = seek[(self.at[h[seek]] > 0) & ~same]
        return out

    def score(self, stream: Stream) -> np.ndarray:
        """log10 probability of each text of the stream."""
        node, code, going = np.zeros(len(stream.bytes), np.int32), np.zeros(len(stream.bytes), _U), np.arange(len(stream.bytes))
        for j, byte in enumerate(stream.before(DEPTH), 1):
            code |= byte.astype(_U) << _U(8 * (j - 1))
            found = self.find(code[going] | _U(j << 56))
            going, found = going[found > 0], found[found > 0]
            node[going] = found
        return np.add.reduceat(self.table[node, stream.bytes].astype(float), stream.start[:-1]) if len(stream.length) else np.zeros(0)


class Whole(NamedTuple):
    """The tree of all contexts, as tables."""

    levels: list[DataFrame]  # by depth: node, stop (the weight of its own estimate), one (its estimate that the bit is 1)
    grams: DataFrame         # key, n, log: every gram of the training text and its log10 probability


def _steps() -> Column:
    """The eight decisions of a gram: its context at full depth above the known bits (after a leading 1), and the bit."""
    key, byte = F.col("key"), F.col("key").bitwiseAND(F.lit(255))
    above = key - byte
    return F.explode(F.array(*(
        F.struct((above + F.shiftright(byte, 8 - i) + F.lit(1 << i)).alias("node"),
                 F.shiftright(byte, 7 - i).bitwiseAND(F.lit(1)).cast("int").alias("bit")) for i in range(8))))


def _shorter(depth: int) -> Column:
    """The node of the same bits in the context's nearest ``depth`` bytes."""
    return F.col("node").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))


def _log_gamma_of(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5, as ``_log_gamma``."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def _answers(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key, log``: the log10 probability of every gram of ``keys`` (distinct), in the training text or not."""
    steps = stored(keys.select("key", _steps().alias("step")).select("key", "step.node", "step.bit"), "steps")
    nodes = steps.select("node").distinct().select("node", F.lit(0.0).alias("done"), F.lit(1.0).alias("left"))
    for d, level in enumerate(levels):
        at = level.select(F.col("node").alias("at"), "stop", "one")
        if d < 2:  # at most 255 and 65,280 rows, which very many nodes ask
            at = F.broadcast(at)
        # a node without counts is undecided, and so are all below it
        stop, one = F.coalesce("stop", F.lit(0.5 if d < DEPTH else 1.0)), F.coalesce("one", F.lit(0.5))
        nodes = nodes.join(at, _shorter(d) == F.col("at"), "left").select(
            "node", (F.col("done") + F.col("left") * stop * one).alias("done"), (F.col("left") * (1 - stop)).alias("left"))
    return (steps.join(nodes, "node").groupBy("key")
            .agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("done")).otherwise(1 - F.col("done")))).alias("log")))


def grow_whole(grams: DataFrame) -> Whole:
    """The tree of all contexts of the gathered grams, weighed from the longest contexts up."""
    levels: list[DataFrame] = []
    counted = (grams.select("n", _steps().alias("step")).groupBy(F.col("step.node").alias("node"))
               .agg(*(F.sum(F.when(F.col("step.bit") == b, F.col("n")).otherwise(0)).alias(f"n{b}") for b in (0, 1))))
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            counted = levels[0].groupBy(_shorter(d).alias("node")).agg(
                F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("deeper"))
        n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
        state = counted.withColumn("own", _log_gamma_of(n0 + 0.5) + _log_gamma_of(n1 + 0.5) - _log_gamma_of(n0 + n1 + 1) - math.log(math.pi))
        own = F.col("own")
        if d < DEPTH:
            both = F.greatest("own", "deeper") + F.log1p(F.exp(-F.abs(own - F.col("deeper")))) - math.log(2)
            state = state.withColumn("weighted", both).withColumn("stop", F.exp(own - math.log(2) - F.col("weighted")))
        else:
            state = state.withColumn("weighted", own).withColumn("stop", F.lit(1.0))
        state = state.select("node", "n0", "n1", "weighted", "stop", ((n1 + 0.5) / (n0 + n1 + 1)).alias("one"))
        levels.insert(0, stored(state, "level"))
    return Whole(levels, stored(grams.join(_answers(grams.select("key"), levels), "key"), "answers"))


def grow(grams: DataFrame, nodes: int) -> Tree:
    """The tree of the ``nodes`` most frequent contexts of all gathered grams, with their counts."""
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
    by_byte = [grams.groupBy(low(d + 1).alias("key")).agg(F.sum("n").alias("n")).select(F.lit(d).alias("depth"), "key", "n")
               for d in range(DEPTH + 1)]
    edges = by_byte[0]
    for more in by_byte[1:]:
        edges = edges.unionByName(more)
    edges = stored(edges.select("depth", F.shiftright("key", 8).alias("context"), low(1).cast("int").alias("byte"), "n"), "edges")
    contexts = edges.groupBy("depth", "context").agg(F.sum("n").alias("n"))
    # a context is never more frequent than the one a byte shorter, so the most frequent ones form a tree
    kept = stored(contexts.orderBy(F.desc("n"), "depth", "context").limit(nodes), "contexts")
    got = edges.join(kept.select("depth", "context"), ["depth", "context"]).toPandas()
    if not len(got):
        got = got.reindex([0]).fillna(0)
    pairs = np.unique((got["depth"].to_numpy(np.int64) << 56) | got["context"].to_numpy(np.int64))
    used = np.unique(got["byte"].to_numpy(int))
    counts = np.zeros((len(pairs), len(used)))
    place = np.searchsorted(pairs, (got["depth"].to_numpy(np.int64) << 56) | got["context"].to_numpy(np.int64))
    counts[place, np.searchsorted(used, got["byte"].to_numpy(int))] = got["n"]
    del got, place
    depth = (pairs >> 56).astype(int)
    shorter = np.where(depth > 0, ((depth - 1) << 56) | (pairs & ((1 << 8 * np.maximum(depth - 1, 0)) - 1)), 0)
    parent = np.where(depth > 0, np.searchsorted(pairs, shorter), -1)
    return Tree(pairs, weigh(counts, depth, parent, used))


def _looked_up(stream: Stream, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sum over the grams of ``keys`` (ascending), and its other grams one text after another with their offsets."""
    n = len(stream.length)
    grams, rows = _grams(stream), np.repeat(np.arange(n), stream.length)
    place = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
    known = keys[place] == grams if len(keys) else np.zeros(len(grams), bool)
    own = np.bincount(rows[known], logs[place[known]], n).astype(float)
    return own, grams[~known], np.concatenate([[0], np.cumsum(np.bincount(rows[~known], minlength=n))])


def train(texts: DataFrame, text: str = "text", nodes: int | None = None) -> tuple[Whole | Tree, DataFrame]:
    """A tree and the token counts (``key, n``; the end is key 0) of all ``texts``; null texts are empty.

    The tree has all contexts, or the ``nodes`` most frequent ones if a number is given.
    """
    texts = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")))
    grams = _gather(texts, _grams, "grams")
    return grow_whole(grams) if nodes is None else grow(grams, nodes), _gather(texts, _tokens, "tokens")


def score(docs: DataFrame, model: tuple[Whole | Tree, DataFrame], text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` added.

    ``base_score`` is the add-one unigram score of the words and the end, ``score`` the tree's log10 probability of the text. Null
    and empty texts are the end alone. All rows stay, repeated ones are scored alike; clashing columns are replaced.
    Words and grams below the hot bounds meet their counts and log-probabilities in a join.
    """
    tree, counts = model
    whole = tree if isinstance(tree, Whole) else None
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    docs = docs.drop(*[c for c in new if c != text])
    *names, uid, more, found, deep = spare(docs, "_tokens", "_known", "_logs", "_score", "_bytes", "_rare", "_seldom", "_uid", "_more", "_found", "_deep")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = counts.where(F.col("n") * HOT >= total).toPandas().sort_values("key")
    spark, rest = docs.sparkSession, [f for f in docs.schema.fields if f.name != text]
    log_all = math.log10(total + kinds + 1)
    if whole is not None:
        length = whole.grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = whole.grams.where(F.col("n") * HOT_GRAMS >= length).select("key", "log").toPandas().sort_values("key")
        tree = (often["key"].to_numpy(np.int64), often["log"].to_numpy(float))
    held = spark.sparkContext.broadcast((tree, hot["key"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)))
    del tree
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys, n = held.value
        logs = np.log10(n + 1.0)
        for batch in batches:
            data, offsets = arrow_texts(batch.column(at).cast(pa.string()))
            for a, b in row_blocks(offsets, _BLOCK):
                stream = Stream(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                every = np.concatenate([stream.hash, np.zeros(b - a, np.int64)])
                rows = np.concatenate([stream.rows, np.arange(b - a)])
                place = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
                known = keys[place] == every if len(keys) else np.zeros(len(every), bool)
                part = np.bincount(rows[known], logs[place[known]], b - a).astype(float)  # of whole numbers if empty
                rare = every[~known][np.argsort(rows[~known], kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows[~known], minlength=b - a))])
                if isinstance(tree, Tree):
                    own, seldom, stops = tree.score(stream), np.zeros(0, np.int64), np.zeros(b - a + 1, np.int64)
                else:
                    own, seldom, stops = _looked_up(stream, *tree)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for k, c in enumerate(batch.columns) if k != at), pa.array(stream.n_words + 1),
                     pa.array(np.bincount(rows[known], minlength=b - a)), pa.array(part), pa.array(own),
                     pa.array(stream.length), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare)),
                     pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(seldom))],
                    names=[*(c for k, c in enumerate(batch.schema.names) if k != at), *names])

    kinds_of = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]
    schema = T.StructType(rest + [T.StructField(c, k) for c, k in zip(names, kinds_of)])
    n_words, n_known, logs, tree_log, size, rare_keys, seldom_keys = names
    first = stored(docs.mapInArrow(run, schema).withColumn(uid, F.monotonically_increasing_id()), "scores")
    rare = first.select(uid, F.explode(rare_keys).alias("key"))
    met = (rare.join(counts.where(F.col("n") * HOT < total), "key")
           .groupBy(uid).agg(F.sum(F.log10(F.col("n") + 1)).alias(more), F.count("*").alias(found)))
    scored = first.join(met, uid, "left")
    if whole is not None:
        seldom = first.select(uid, F.explode(seldom_keys).alias("key"))
        fresh = stored(seldom.select("key").distinct().join(whole.grams.select("key"), "key", "left_anti"), "fresh")
        every = whole.grams.where(F.col("n") * HOT_GRAMS < length).select("key", "log").unionByName(_answers(fresh, whole.levels))
        scored = (scored.join(seldom.join(every, "key").groupBy(uid).agg(F.sum("log").alias(deep)), uid, "left")
                  .withColumn(tree_log, F.col(tree_log) + F.coalesce(deep, F.lit(0.0))))
    return scored.select(
        *[f.name for f in rest], F.col(n_words).alias("n_tokens"), (F.col(n_known) + F.coalesce(found, F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col(logs) + F.coalesce(more, F.lit(0.0)) - F.col(n_words) * F.lit(log_all)).alias("base_score"),
        F.col(tree_log).alias("score"), F.col(size).alias("n_bytes"),
        (-F.col(tree_log) / (F.col(size) * math.log10(2))).alias("bits_per_byte"))
