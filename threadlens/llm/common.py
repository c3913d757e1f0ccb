"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.keyfilter import FILTER_BITS, filter_places, in_filter, key_filter, maybe_in  # noqa: F401
from threadlens.session import ensure_checkpoint_dir

#: ASCII white space, the separators of the word contracts: 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of a value written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True for rows whose ``crc32(key as text) mod modulus`` is ``remainder`` (a null key is never held out)."""
    return F.coalesce(crc32_of(F.col(key)) % modulus == remainder, F.lit(False))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and go on from the files (cuts lineage, survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column, without a copy of the bytes (null: empty)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes together (a longer row stands alone)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def give_back() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system.

    Spark keeps workers, and the allocators of C and Arrow keep what was freed; over the stages of a job that adds up.
    """
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)
