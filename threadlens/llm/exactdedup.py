"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside groups, keep one row of each group.

Texts are equal when they are identical after every ASCII white-space character is deleted. A group keeps the row with the most
code points in its original text, then the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import stored

#: A group with more than this share of all rows is joined by broadcast: at most 1,023 groups are that large.
HOT_SHARE = 1024


def normalised(col: Column) -> Column:
    """A text without its ASCII white space (0x20, 0x09-0x0D); a null text is empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+", "")


def hash128(col: Column) -> Column:
    """The 16 bytes of a text's MD5."""
    return F.unhex(F.md5(col))


def _clashes(docs: DataFrame, text: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    """``hash`` of every hash value that two different texts share (none, unless somebody made a collision).

    Texts are grouped with their hash, so Spark compares their bytes. Equal texts are combined before the shuffle: a task sends
    each of its texts once, whatever the number of copies.
    """
    texts = docs.select(normalised(F.col(text)).alias("body")).select(content_hash(F.col("body")).alias("hash"), "body").distinct()
    return stored(texts.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"), "clashes")


def _grouped(docs: DataFrame, carried: Column, id_col: str, text_col: str,
             content_hash: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (uid, carried, hash, body, ...) and ``groups`` (hash, body, group_size, keep_id, keep_uid).

    ``body`` is empty but for hashes that different texts share: there it holds the text, so such texts are groups of their own.
    """
    clashes = _clashes(docs, text_col, content_hash)
    rows = docs.select(carried.alias("carried"), F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
                       normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumns({"hash": content_hash(F.col("norm")), "sha": F.unhex(F.sha2(F.col("norm"), 256))})
    if clashes.isEmpty():
        rows = rows.withColumn("body", F.lit(""))
    else:
        shared = clashes.withColumn("clash", F.lit(True))
        rows = rows.join(shared, "hash", "left").withColumn("body", F.when(F.col("clash"), F.concat(F.lit("="), "norm")).otherwise(""))
    rows = stored(rows.select("carried", "id", "n", "hash", "sha", "body", F.monotonically_increasing_id().alias("uid")), "rows")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.isnull("id").alias("last"), "id", "uid")).alias("best")
    groups = rows.groupBy("hash", "body").agg(F.count("*").alias("group_size"), best)
    return rows, stored(groups.select("hash", "body", "group_size", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid")), "groups")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Null and empty texts, and those of white space alone, are one group. Ties in code points go to the smallest id (null ids
    last), and of rows that are the same in id and length exactly one is kept. Other columns are not read. An empty table gives
    an empty one. No text is shuffled for the result: rows meet their groups by hash, and the few groups that hold more than a
    1,024th of the rows each are broadcast, so no task gets a hot group.
    """
    rows, groups = _grouped(docs, F.lit(None).cast("string"), id_col, text_col, content_hash)
    rows, total = rows.drop("carried"), rows.count()
    hot = F.broadcast(groups.where((F.col("group_size") * HOT_SHARE > total) & (F.col("body") == "")).drop("body"))
    cold = groups.where((F.col("group_size") * HOT_SHARE <= total) | (F.col("body") != ""))
    plain = F.col("body") == ""
    few = rows.where(plain).join(hot, "hash")
    many = rows.join(hot.select("hash", F.lit("").alias("body")), ["hash", "body"], "left_anti").join(cold, ["hash", "body"])
    cols = [F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256")]
    return few.select(*cols).unionByName(many.select(*cols))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with all columns: one of each group of equal texts (rules as in ``classes``)."""
    rows, groups = _grouped(docs, F.struct(*[docs[c] for c in docs.columns]), id_col, text_col, content_hash)
    return rows.join(groups.select(F.col("keep_uid").alias("uid")), "uid", "left_semi").select("carried.*")


def oracle_sql() -> str:
    """DuckDB SQL of ``classes`` over ``documents``."""
    return r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
           FROM documents),
w AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM w"""
