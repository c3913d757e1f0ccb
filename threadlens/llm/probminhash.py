"""Near-duplicate documents by ProbMinHash signatures, banding, and exact verification.

A document's weighted set has its five-word shingles, each weighing as often as it occurs. Every shingle sends
arrivals of a Poisson process with its weight as the rate to random registers, and a register keeps the shingle of
its first arrival; two documents agree in a register with the probability Jaccard similarity of their sets. As links are
verified on distinct shingles, a document with repeated ones has bands of the same process with all weights 1 as well,
so that documents which differ in how often a passage occurs meet too. A shingle stops once its next arrival comes after the latest first arrival of any register.

Texts with the same words are copies and form one node. Nodes that share a band of registers are candidates. In
each bucket of more than a few nodes all are compared with one hub, not with each other. Jaccard distance is a metric, so a node with a
similarity under 0.6 to the hub has no partner of 0.8 among the nodes that have 0.8 to the hub; nodes that the hub did not take go on
with the next hub. What may still lack a link after the hub rounds (nodes between 0.6 and 0.8 to a hub, and those left in a bucket) is
searched among all nodes by an exact prefix filter: two sets with a similarity of 0.8 share one of the rarest fifth of both's shingles.
So no link between candidates is lost, and no bucket is compared with itself.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm import words
from threadlens.llm.common import arrow_texts, filter_places, give_back, in_filter, key_filter, maybe_in, row_blocks, stored
from threadlens.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Nodes of a bucket that are compared with each other at once; more have hubs.
FEW = 4
#: Hubs tried in a bucket before the rest is searched by the prefix filter.
HUB_ROUNDS = 2
_U = np.uint64
_BLOCK = 1_500_000


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """``rows, shingles, weights`` of many texts: distinct shingle hashes (44 bits) by row, and how often each occurs.

    A text of fewer words than ``size``, but not none, has all its words as one shingle.
    """
    n = len(offsets) - 1
    starts, ends, rows = words.spans(data, offsets, words.ALNUM)
    each = words.hashes(words.LOWER[data], starts, ends)
    runs = words.runs(each, size)
    whole = rows[:len(runs)] == rows[size - 1:] if len(runs) else np.zeros(0, bool)
    keys = [(rows[:len(runs)][whole].astype(_U) << _U(44)) | (runs[whole] >> _U(20))]
    count = np.bincount(rows, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    for r in np.flatnonzero((count > 0) & (count < size)).tolist():
        short = words.runs(each[at[r]:at[r + 1]], int(count[r]), seed=int(count[r]) + 1)
        keys.append((_U(r) << _U(44)) | (short >> _U(20)))
    found, weights = np.unique(np.concatenate(keys), return_counts=True)
    return (found >> _U(44)).astype(np.int64), found & _U((1 << 44) - 1), weights


def signatures(rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """An ``n x registers`` array of the shingles that came first (0 for rows without shingles)."""
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, _U)
    seed, x = words.mix(shingles + _U(0x632BE59BD9B4E019)), np.zeros(len(shingles))
    row, weight, left = rows, weights.astype(float), np.arange(len(shingles))
    step = 0
    while len(left):
        step += 1
        u = words.mix(seed[left] + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        x[left] -= np.log(((u >> _U(11)).astype(float) + 0.5) * 2.0 ** -53) / weight[left]
        when = x[left]
        slot = row[left] * registers + (words.mix(u ^ _U(0xA0761D6478BD642F)) % _U(registers)).astype(np.int64)
        better = when < first[slot]
        slot, when, by = slot[better], when[better], shingles[left[better]]
        np.minimum.at(first, slot, when)
        won = when == first[slot]
        who[slot[won]] = by[won]
        live = np.unique(row[left])
        latest = np.full(n, -1.0)
        latest[live] = first.reshape(n, registers)[live].max(axis=1)
        left = left[x[left] < latest[row[left]]]
    return who.reshape(n, registers)


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of registers."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0xD1342543DE82EF95) + np.zeros((len(signature), 1), _U)
    for j in range(rows):
        key = words.mix(key ^ words.mix(parts[:, :, j]))
    return key.view(np.int64)


def _copies(text: bytes) -> bytes | None:
    """128 bits of a text's words; equal for texts with the same words, None without words."""
    flat = b" ".join(text.translate(_NORMAL).split())
    return hashlib.blake2b(flat, digest_size=16).digest() if flat else None


_NORMAL = bytes(int(words.LOWER[b]) if words.ALNUM[b] else 32 for b in range(256))


def _both_bands(row: np.ndarray, found: np.ndarray, weight: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ``n`` texts one after another and their offsets: those of the weighted set, then others of the distinct shingles."""
    keys = _bands(signatures(row, found, weight, n, bands * rows), bands, rows)
    repeated = np.unique(row[weight > 1])  # in all other texts the two sets are the same
    part = np.isin(row, repeated)
    plain = signatures(np.searchsorted(repeated, row[part]), found[part], np.ones(part.sum()), len(repeated), bands * rows)
    plain = _bands(plain, bands, rows)
    fresh = plain != keys[repeated]
    of = np.concatenate([np.repeat(np.arange(n), bands), np.repeat(repeated, fresh.sum(axis=1))])
    order = np.argsort(of, kind="stable")
    return np.concatenate([keys.ravel(), plain[fresh]])[order], np.searchsorted(of[order], np.arange(n + 1))


def sketch(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """``doc_id, node, bands`` of every row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            data, offsets = arrow_texts(batch.column(1))
            for a, b in row_blocks(offsets, _BLOCK):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, found, weight = weighted_shingles(part, at, shingle)
                keys, ends = _both_bands(row, found, weight, b - a, bands, rows)
                raw = part.tobytes()
                nodes = [_copies(raw[at[k]:at[k + 1]]) for k in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(nodes, pa.binary()), lists],
                                                 names=["doc_id", "node", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` (distinct, as 64-bit numbers) of every row with words whose ``doc_id`` is in ``wanted``, and of few others."""
    keys = key_filter(wanted, "doc_id")
    docs = docs.select("doc_id", "text", *(p.alias(f"p{k}") for k, p in enumerate(filter_places(F.col("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(keys.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())))
            data, offsets = arrow_texts(batch.column(1))
            for a, b in row_blocks(offsets, _BLOCK):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                row, found, _ = weighted_shingles(part, at, shingle)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                raw = part.tobytes()
                nodes = [_copies(raw[at[k]:at[k + 1]]) for k in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), lists], names=["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles array<bigint>").where("node IS NOT NULL")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with the Jaccard similarity of their shingle sets."""
    left = sets.withColumnsRenamed({"node": "a", "shingles": "sa"})
    right = sets.withColumnsRenamed({"node": "b", "shingles": "sb"})
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity")))


def _labels(links: DataFrame, degree: DataFrame) -> DataFrame:
    """``node, label``: each linked node's best neighbour's best neighbour; equal labels mean that a path joins the nodes."""
    sides = links.select("a", "b").union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b"))
    label = sides.toDF("node", "next").join(degree.withColumnRenamed("node", "next"), "next") \
                 .groupBy("node").agg(F.max(F.struct("degree", "next"))["next"].alias("label"))
    return label.join(label.toDF("label", "far"), "label").select("node", F.col("far").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs`` (``doc_id, text``): rows of a class are joined by copies and links.

    A link is a Jaccard similarity of ``similarity`` or more between distinct shingles. ``class_id`` is the smallest
    ``doc_id`` of the class. Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII; null, empty and
    wordless texts are classes of their own. Repeated rows are copies. Other columns are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketched = stored(sketch(docs, bands, rows, shingle), "sketch")
    labels = _components(docs, sketched, similarity, shingle)
    named = (sketched.select("doc_id", "node").join(labels, "node", "left")
             .select("doc_id", F.coalesce("label", "node").alias("label")))
    classes = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(classes, "label", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _components(docs: DataFrame, sketched: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``node, label`` of every node with a link: those that verified links join have the same label."""
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "bands")).alias("one"))
    members = nodes.select("node", F.col("one.doc_id").alias("doc_id"), F.explode("one.bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "bucket"), "shared")
    # the node that meets the most others is the best hub
    degree = stored(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    wanted = stored(shared.select("doc_id").distinct(), "wanted")
    # texts stay where they are: a filter of bounded size picks them, and only shingle sets are shuffled
    sets = shingle_sets(docs, shingle, wanted).dropDuplicates(["node"])
    sets = stored(sets.join(degree.select("node"), "node", "left_semi"), "sets")
    left = shared.select("bucket", "n", "node")
    links, owed = [], []
    for _ in range(HUB_ROUNDS):
        few, many = left.where(F.col("n") <= FEW), left.where(F.col("n") > FEW).join(degree, "node")
        hubs = many.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("b"))
        star = stored(many.join(hubs, "bucket").select("bucket", F.col("node").alias("a"), "b").where("a != b"), "star")
        each = few.select("bucket", F.col("node").alias("a")).join(few.select("bucket", F.col("node").alias("b")), "bucket").where("a < b")
        pairs = star.select("a", "b").union(each.select("a", "b")).distinct()
        judged = stored(_similar(pairs, sets), "judged")
        links.append(judged.where(F.col("similarity") >= similarity).select("a", "b"))
        missed = star.join(judged.where(F.col("similarity") < similarity), ["a", "b"])
        owed.append(judged.where((F.col("similarity") < similarity) & (F.col("similarity") >= 2 * similarity - 1))
                    .join(star.select("a", "b").distinct(), ["a", "b"], "left_semi").select(F.col("a").alias("node"), F.col("b").alias("hub")))
        # nodes that no hub took go on, without the hub, in buckets where they are not all joined by now
        label = stored(_labels(_all(links), degree), "label")
        rest = stored(missed.select("bucket", F.col("a").alias("node")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "rest")
        open_ = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        left = stored(rest.join(open_.select("bucket", "n"), "bucket").select("bucket", "n", "node"), "left")
        if left.isEmpty():
            break
    label = components(_all(links))
    of = lambda c: label.withColumnsRenamed({"node": c, "label": f"of_{c}"})
    # a node near a hub may be nearer to one that the hub took, unless links join it to the hub by now
    lone = _all(owed).distinct().join(of("node"), "node", "left").join(of("hub"), "hub", "left")
    lone = lone.where("of_node IS NULL OR of_hub IS NULL OR of_node != of_hub").select("node")
    # and the nodes of a bucket that are left may have links among themselves, unless they are all joined
    rest = left.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    lone = stored(lone.union(rest.join(open_, "bucket").select("node")).distinct(), "lone")
    if lone.isEmpty():
        return label
    pairs = _prefix_pairs(lone, sets, label, similarity)
    more = stored(_similar(pairs, sets).where(F.col("similarity") >= similarity).select("a", "b"), "more")
    return _joined(label, more)


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """``label`` (``node, label``) after the links ``more`` (``a, b``): components of the labels, which are far fewer than the nodes."""
    of = lambda c: label.withColumnsRenamed({"node": c, "label": f"of_{c}"})
    name = lambda c: F.coalesce(f"of_{c}", c).alias(c)
    far = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(name("a"), name("b"))) \
        .select(F.col("node").alias("label"), F.col("label").alias("far"))
    fresh = more.select("a").union(more.select("b")).toDF("node").distinct().join(label, "node", "left_anti")
    nodes = label.union(fresh.select("node", F.col("node").alias("label")))
    return nodes.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _prefix_pairs(lone: DataFrame, sets: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: each node ``a`` of ``lone`` with every node ``b`` of another label whose similarity can reach the threshold.

    Shingles are ordered by the number of nodes that have them. All but ``similarity`` of a set and one more are its prefix: two
    sets that are similar share a shingle of both prefixes, and from the first one that they share on both have enough left. So a passage that
    many texts have is posted only where a text has little else, and shingles of one text alone are never posted.
    """
    flat = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    df = flat.groupBy("s").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    needed = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    prefix = flat.join(df, "s").withColumn("place", place).where((F.col("place") <= needed) & (F.col("df") > 1))
    prefix = stored(prefix.join(label, "node", "left").select("node", "s", "size", "place", F.coalesce("label", "node").alias("label")), "prefix")
    met = prefix.withColumnsRenamed({"node": "b", "size": "size_b", "place": "place_b", "label": "label_b"})
    probe = prefix.join(lone, "node").withColumnsRenamed({"node": "a", "size": "size_a", "place": "place_a", "label": "label_a"})
    overlap = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    left = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    fits = (left >= overlap) & (F.least("size_a", "size_b") >= (similarity - 1e-9) * F.greatest("size_a", "size_b"))
    return stored(probe.join(met, "s").where(fits & (F.col("label_a") != F.col("label_b"))).select("a", "b").distinct(), "met")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the document with the smallest id, once.

    Columns and rows are otherwise as they came; rows without words all stay. A document that is the only row of its id and stays
    is kept where it is; only the others, and the few that a filter of bounded size cannot tell from them, are shuffled.
    """
    classes = stored(near_duplicates(docs, **options), "classes")
    same_id = F.col("doc_id").eqNullSafe(F.col("class_id"))
    ids = stored(classes.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count(F.when(same_id, True)).alias("n")), "ids")
    odd = maybe_in(ids.where("rows > 1 OR n = 0").select("doc_id"), "doc_id", F.col("doc_id"))
    kept = ids.where("n > 0")
    once, often = kept.where("n = 1"), kept.where("n > 1")
    part = lambda ids: docs.where(odd).join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    same = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    return docs.where(~odd).unionByName(part(once)).unionByName(part(often).dropDuplicates(same))
