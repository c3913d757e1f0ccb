"""A broadcast filter of the keys of a table: 8 MB, whatever the table's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter that tells which keys may be in a table: 8 MB, whatever the table's size.
FILTER_BITS = 1 << 26


def filter_places(key: Column) -> list[Column]:
    """Two places of a key in the filter, from the low and the high bits of its hash."""
    h = F.xxhash64(key)
    return [h.bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(FILTER_BITS - 1)]


def key_filter(table: DataFrame, column: str):
    """A broadcast filter of the keys in ``table``'s column, for :func:`in_filter`: it holds all of them, and few others while the
    table has up to some million keys.

    The filter is put together on the executors; the driver gets its words (at most 2^20), and each task the same 8 MB. In a
    table of many more keys it lets more rows through, which costs time but no row: an exact join has to follow.
    """
    spark = table.sparkSession
    places = table.select(F.explode(F.array(*filter_places(F.col(column)))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits)


def in_filter(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys, given by their two places, may be in the filter."""
    return (bits[a >> 6] >> (a & 63) & 1 & (bits[b >> 6] >> (b & 63))) == 1


def maybe_in(table: DataFrame, column: str, key: Column) -> Column:
    """A condition that holds for every ``key`` in ``table``'s column and for few others (see :func:`key_filter`)."""
    sent = key_filter(table, column)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, a.to_numpy(), b.to_numpy()))

    return held(*filter_places(key))
