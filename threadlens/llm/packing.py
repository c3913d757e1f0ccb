"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

Pieces are dealt by a hash of their row number into shards of about ``shard_pieces`` pieces. Each
shard is packed best-fit decreasing and then improved: pieces move, or are exchanged one for one, two
for one and one for two, from the emptiest bins to fuller ones. Every step raises the sum of squared
fills, so bins empty out and the search ends. A shard leaves about one bin partly filled, so the loss
against packing all pieces at once is at most about one sequence in each shard.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import give_back, spare, stored
from threadlens.llm.encode import KEPT, encoder

CAPACITY = 2048
SHARD_PIECES = 16_384
#: Emptiest bins that give pieces away in a round, and the most rounds of a shard's search.
DONORS = 64
ROUNDS = 40

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType())])


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, most: int = CAPACITY,
           with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """Token pieces of every document (``doc_id, text``): ids of the whole text and ``end_id``, cut every ``most`` ids.

    Null and empty texts give one piece with the end id alone. Repeated rows are documents of their
    own. ``with_ids`` adds the ids as an array. ``kept`` bounds the words whose ids a worker keeps, not the result.
    Other columns are not read.
    """
    schema = T.StructType(list(PIECES.fields) + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, end = encoder(tokenizer_path, kept), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at:at + 4 * most]
                    row = [doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [[]] * len(schema.fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(table: DataFrame, length: str = "length", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each row of ``table``, whose ``length`` says how much room it takes.

    Rows keep all their columns (two clashing names are replaced). Lengths are 0 to ``capacity``; a
    null, negative or longer one raises. Equal lengths and repeated rows are packed like any others; an empty table
    gives an empty one.
    """
    table = table.drop("sequence_id", "offset")
    (uid, shard), size = spare(table, "uid", "shard"), length
    # rows are numbered as they are written: the numbers, and so the shards, stay the same on any retry
    table = stored(table.withColumn(uid, F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-table.count() // shard_pieces))
    schema = T.StructType([f for f in table.schema.fields if f.name != uid]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(uid, kind="stable")
        lengths = rows[size].to_numpy()
        bad = pd.isna(lengths) | (lengths < 0) | (lengths > capacity)
        if bad.any():
            raise ValueError(f"a length is not within 0 and {capacity}: {lengths[bad][0]}")
        bins, offsets = fill(lengths.astype(np.int64), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        rows["offset"] = offsets
        return rows[schema.names]

    return (table.withColumn(shard, F.pmod(F.xxhash64(F.col(uid)), F.lit(shards)))
            .groupBy(shard).applyInPandas(one, schema))


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: best-fit decreasing, then the local search."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, members in enumerate(bins):
        at = 0
        for i in sorted(members):
            number[i], offset[i] = k, at
            at += int(lengths[i])
    return number, offset


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the open bin that it leaves with the least room."""
    bins: list[list[int]] = []
    room_of: dict[int, list[int]] = {}  # room -> bins
    rooms = 0                           # a bit for each room that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            k = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        room_of.setdefault(room - n, []).append(k)
        rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search over underfull bins; stops at the lower bound, or when a round finds no step."""
    size = [int(n) for n in lengths]
    fills = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(size) // capacity)
    tried: set[int] = set()
    for _ in range(ROUNDS):
        open_bins = sorted((k for k, f in enumerate(fills) if bins[k] and f < capacity), key=lambda k: fills[k])
        if sum(1 for b in bins if b) <= least or len(open_bins) < 2:
            break
        donors = [k for k in open_bins if k not in tried][:DONORS]
        if not donors:
            break
        before = sum(f * f for f in fills)
        _round(bins, fills, size, donors, open_bins[::-1], capacity)
        if sum(f * f for f in fills) == before:
            tried.update(donors)  # these give nothing away; the next emptiest have their turn
        else:
            tried.clear()
    return [b for b in bins if b]


def _round(bins, fills, size, donors, targets, capacity) -> None:
    """Each target, the fullest first, takes from the donors while that raises the squared fill."""
    singles: dict[int, set[tuple[int, int]]] = {}             # length -> (bin, piece)
    doubles: dict[int, set[tuple[int, int, int]]] = {}        # sum of two lengths -> (bin, piece, piece)

    def list_bin(k, add):
        change = set.add if add else set.discard
        own = bins[k]
        for a, i in enumerate(own):
            change(singles.setdefault(size[i], set()), (k, i))
            for j in own[a + 1:a + 9]:  # a donor's neighbours; longer bins offer their single pieces
                change(doubles.setdefault(size[i] + size[j], set()), (k, i, j))

    for k in donors:
        list_bin(k, True)
    donor_set = set(donors)

    def step(t) -> bool:
        gap, own = capacity - fills[t], bins[t]
        # what may leave the target: nothing, one piece, or two pieces for one
        leave = [((), 0)] + [((i,), size[i]) for i in own[:16]]
        pairs = [((i, j), size[i] + size[j]) for a, i in enumerate(own[:8]) for j in own[a + 1:8]]
        for want in range(gap, max(0, gap - 16), -1):  # the fullest result first
            for out, n in leave + pairs:
                for offers in ((singles,) if len(out) == 2 else (singles, doubles)):
                    for source in offers.get(n + want, ()):
                        if source[0] != t and fills[source[0]] < fills[t] + want:
                            return swap(t, source[0], out, source[1:], want)
        # else the largest single piece that fits
        for n in sorted((n for n, s in singles.items() if n <= gap and s), reverse=True):
            for d, i in singles[n]:
                if n and d != t and fills[d] < fills[t] + n:
                    return swap(t, d, (), (i,), n)
        return False

    def swap(t, d, out, into, gain) -> bool:
        for k in (t, d):
            if k in donor_set:
                list_bin(k, False)
        bins[t] = [i for i in bins[t] if i not in out] + list(into)
        bins[d] = [i for i in bins[d] if i not in into] + list(out)
        fills[t] += gain
        fills[d] -= gain
        for k in (t, d):
            if k in donor_set:
                list_bin(k, True)
        return True

    for t in targets:
        while bins[t] and fills[t] < capacity and step(t):
            pass
