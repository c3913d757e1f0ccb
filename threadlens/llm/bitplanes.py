"""Token ids in binary shards: fixed-size blocks of ids, turned into byte or bit planes, each plane under zstandard.

A shard file is ``MAGIC``, the planes of its chunks one after another, the index (Arrow stream: one
row per chunk with its place, number of ids and the length of each plane), the documents (Arrow stream:
``doc_id``, ``n_tokens`` in order), the two tables' lengths (two unsigned 64-bit numbers) and ``MAGIC``.
Ids of a document may cross chunks, never shards.

Files are written below a shared folder through ``pyarrow.fs`` under names of their own for each
attempt. A shard counts when Spark has committed its row in the ``manifest`` table, so files of lost or repeated attempts
are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.encode import encoder

MAGIC = b"IDPLANE1"
CHUNK_IDS = 65_536
MANIFEST = "shard int, file string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of 32-bit ids: 4 byte planes, or as many bit planes as the largest id needs."""
    if not bits:
        return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    wide = max(1, int(ids.max(initial=0)).bit_length())
    return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(wide)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


class ShardWriter:
    """Writes one shard; holds one chunk of ids and the documents' lengths."""

    def __init__(self, out, chunk_ids: int, bits: bool, level: int = 3):
        self.out, self.chunk, self.bits = out, 4 * chunk_ids, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.index, self.doc_ids, self.counts, self.n_ids = bytearray(), [], [], [], 0
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held += ids
        whole = len(self.held) // self.chunk * self.chunk
        for k in range(0, whole, self.chunk):
            self._write(bytes(self.held[k:k + self.chunk]))
        del self.held[:whole]

    def _write(self, raw: bytes) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.bits)]
        self.index.append({"at": self.at, "n_ids": len(raw) // 4, "planes": [len(p) for p in planes]})
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._write(bytes(self.held))
        kind = pa.schema([("at", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.list_(pa.int64()))],
                         metadata={"planes": json.dumps("bits" if self.bits else "bytes")})
        index = _stream(pa.Table.from_pylist(self.index, schema=kind))
        docs = _stream(pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())}))
        self.out.write(index + docs + struct.pack("<QQ", len(index), len(docs)) + MAGIC)


class ShardReader:
    """Reads one shard chunk by chunk; ``chunk(k)`` takes a single chunk by the index."""

    def __init__(self, file):
        self.file, tail = file, 16 + len(MAGIC)
        size = file.size()
        head = file.read_at(len(MAGIC), 0)
        end = file.read_at(tail, size - tail)
        if head != MAGIC or end[16:] != MAGIC:
            raise ValueError("not a whole shard")
        n_index, n_docs = struct.unpack("<QQ", end[:16])
        raw = file.read_at(n_index + n_docs, size - tail - n_index - n_docs)
        index = pa.ipc.open_stream(raw[:n_index]).read_all()
        self.bits = json.loads(index.schema.metadata[b"planes"]) == "bits"
        self.index = index.to_pylist()
        self.docs = pa.ipc.open_stream(raw[n_index:]).read_all()
        self.zstd = zstandard.ZstdDecompressor()

    def chunk(self, k: int) -> np.ndarray:
        entry = self.index[k]
        raw, planes, at = self.file.read_at(sum(entry["planes"]), entry["at"]), [], 0
        for n in entry["planes"]:
            planes.append(self.zstd.decompress(raw[at:at + n]))
            at += n
        return from_planes(planes, entry["n_ids"], self.bits)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and token ids (little-endian 32-bit), in the order they were written."""
        held, chunks = bytearray(), iter(range(len(self.index)))
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n_tokens"].to_pylist()):
            while len(held) < 4 * n:
                held += self.chunk(next(chunks)).tobytes()
            yield doc_id, bytes(held[:4 * n])
            del held[:4 * n]


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, chunk_ids: int = CHUNK_IDS,
              bits: bool = False) -> str:
    """Write the ids of every document (``doc_id, text``), each with ``end_id`` after it, in ascending ``doc_id`` order.

    Null texts are empty (the end id alone), null ids come first, rows of one id stand in the order of
    their texts' hashes. An empty table writes no shard. Returns ``folder``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        shard, writer, name = TaskContext.get().partitionId(), None, None
        fs, root = _filesystem(folder)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    name = f"ids-{shard:06d}-{uuid.uuid4().hex[:12]}.planes"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(out, chunk_ids, bits)
                writer.add(doc_id, enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "file": pa.array([name]),
                "n_docs": pa.array([len(writer.counts)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a written folder: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    ``with_ids`` adds the ids as an array. The driver reads the manifest, one row per shard file.
    """
    files, start = [], 0
    for row in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect():
        files.append((row.file, start))
        start += row.n_ids
    schema = DOCS + (", ids array<int>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 4 + ([pa.list_(pa.int32())] if with_ids else [])
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with fs.open_input_file(f"{root}/{name}") as file:
                    for doc_id, ids in ShardReader(file).documents():
                        n = len(ids) // 4
                        row = (doc_id, at, n, zlib.crc32(ids))
                        rows.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
                        at += n
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.createDataFrame(files, "file string, at long").repartition(len(files)).mapInArrow(read, schema)
