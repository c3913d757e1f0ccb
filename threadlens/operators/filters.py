"""B*: projections, filters and predicates over the item table."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(df: DataFrame, mode: str = "falsy") -> DataFrame:
    """B1: drop deleted and dead items.

    ``falsy``: a flag that is null or false keeps the row. ``exists``: only a
    missing (null) flag keeps it, the key-absent test of a document store.
    """
    if mode == "falsy":
        return df.where(~F.coalesce(F.col("deleted"), F.lit(False))
                        & ~F.coalesce(F.col("dead"), F.lit(False)))
    if mode == "exists":
        return df.where(F.col("deleted").isNull() & F.col("dead").isNull())
    raise ValueError(f"unknown live mode {mode!r}")


def stories(df: DataFrame) -> DataFrame:
    """B2: stories that have a title."""
    return df.where((F.col("type") == "story") & F.col("title").isNotNull())


def id_range(df: DataFrame, lo=None, hi=None, bounds: str = "[]", col: str = "id") -> DataFrame:
    """Id range; ``bounds`` is one of ``[]``, ``()``, ``[)``, ``(]``. Parquet min/max stats prune row groups."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo if bounds[0] == "[" else c > lo)
    if hi is not None:
        cond = cond & (c <= hi if bounds[1] == "]" else c < hi)
    return df.where(cond)


def ids_in(df: DataFrame, ids: DataFrame, col: str = "id", ids_col: str = "id") -> DataFrame:
    """Id-set membership as a left-semi join (AQE broadcasts the id side when it is small)."""
    keys = ids.select(F.col(ids_col).alias("_k")).distinct()
    return df.join(keys, df[col] == keys["_k"], "left_semi")


def by_author(df: DataFrame, who: str) -> DataFrame:
    """Items written by one author."""
    return df.where(F.col("by") == F.lit(who))


def min_descendants(df: DataFrame, n: int) -> DataFrame:
    """Stories whose stored comment count exceeds ``n``."""
    return df.where(F.col("descendants") > n)


def category_filter(df: DataFrame, allow: Iterable[str] | DataFrame, cat_col: str = "subreddit",
                    body_col: str = "body", deleted_marker: str = "[deleted]") -> DataFrame:
    """Keep allow-listed categories and drop deleted bodies.

    A literal allow-list compiles to a hash set (``InSet``) inside the scan stage, without a join. One that is a table (its first
    column, as :func:`readers.read_allowlist` returns it) is a semi-join, whatever its size.
    """
    if isinstance(allow, DataFrame):
        names = allow.select(F.col(allow.columns[0]).alias("_allowed"))
        kept = df.where(F.col(body_col) != F.lit(deleted_marker))
        return kept.join(names, kept[cat_col] == names["_allowed"], "left_semi")
    allow = list(allow)
    return df.where(F.col(cat_col).isin(allow) & (F.col(body_col) != F.lit(deleted_marker)))


def project_story(df: DataFrame) -> DataFrame:
    """The story header fields."""
    return df.select("title", "score", "descendants", "id", "url")


def cap_kids(df: DataFrame, limit: int) -> DataFrame:
    """Remove kid ids at or above ``limit`` from each ``kids`` array."""
    return df.withColumn("kids", F.filter(F.col("kids"), lambda k: k < F.lit(limit)))


def single_reply_comments(items: DataFrame) -> DataFrame:
    """First-level comments (parent is a story) that have exactly one kid."""
    story_ids = items.where(F.col("type") == "story").select(F.col("id").alias("_sid"))
    first = items.where(F.col("type") == "comment")
    first = first.join(story_ids, first["parent"] == story_ids["_sid"], "left_semi")
    return first.where(F.size(F.coalesce(F.col("kids"), F.array().cast("array<bigint>"))) == 1)


def admit_kids(items: DataFrame) -> DataFrame:
    """``(parent, kid)`` for each listed kid that exists, is a comment and is not deleted."""
    listed = items.select(F.col("id").alias("parent"), F.explode(F.col("kids")).alias("kid"))
    kid_rows = items.select(F.col("id").alias("_kid"), "type", "deleted")
    joined = listed.join(kid_rows, listed["kid"] == kid_rows["_kid"], "inner")
    return joined.where((F.col("type") == "comment") & ~F.coalesce(F.col("deleted"), F.lit(False))) \
                 .select("parent", "kid")
