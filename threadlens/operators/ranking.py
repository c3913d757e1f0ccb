"""Ordering, top-n and top-k per group."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by(df: DataFrame, col: str, tie: str = "id") -> DataFrame:
    """Sort descending by ``col``, ties by ``tie`` ascending (a range-partitioned sort)."""
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(tie).asc())


def top_n(df: DataFrame, n: int, col: str, tie: str = "id") -> DataFrame:
    """The first ``n`` rows of :func:`rank_by` (TakeOrderedAndProject: each task keeps n rows)."""
    return rank_by(df, col, tie).limit(n)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """The ``k`` best rows per group by ``order`` (1-based ``rank``).

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so a group holding a third of the rows ships only ``k`` rows per
    map task to the final window.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
