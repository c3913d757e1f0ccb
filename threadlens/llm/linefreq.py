"""Line deduplication by site-relative frequency.

Within a host, a line's frequency is the number of the host's pages that contain it, divided by the
number of the host's pages. Lines above the boilerplate ratio are dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import spare

RATIO = 0.1
MIN_PAGES = 5


def _line(col: Column) -> Column:
    """A line as it is compared: without blanks, tabs and carriage returns at its ends."""
    return F.btrim(col, F.lit(" \t\r"))


def _key(col: Column) -> Column:
    """96 bits of a line's two hashes; what is shuffled instead of the line."""
    return F.struct(F.xxhash64(col).alias("a"), F.hash(col).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                copies: bool = True) -> DataFrame:
    """``host, lines``: per host the keys of lines on more than ``ratio`` of its pages and on ``min_pages`` at least.

    A host has at most (lines per page) / ``ratio`` such lines, so the array is bounded whatever the host's size. Counts are
    combined before the shuffle, so a host with a third of all pages, or a line on all of them, is no burden. Without ``copies``,
    a host's pages of equal text count as one.
    """
    pages = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _line))
    if copies:
        found = pages.select("host", F.explode(lines).alias("line")).where("line != ''").select("host", _key(F.col("line")).alias("key"))
    else:
        keys = F.transform(F.filter(lines, lambda x: x != ""), _key)
        pages = pages.select("host", _key(F.col("text")).alias("page"), keys.alias("keys")) \
                     .groupBy("host", "page").agg(F.first("keys").alias("keys"))
        found = pages.select("host", F.explode("keys").alias("key"))
    on = (found.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    return (on.join(total, on["host"].eqNullSafe(total["host"])).where(F.col("n") > ratio * F.col("total"))
            .groupBy(on["host"].alias("host")).agg(F.collect_list("key").alias("lines")))


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, counts: bool = True, copies: bool = True) -> DataFrame:
    """``pages`` with the boilerplate lines of their host removed from ``text``; with ``counts`` also ``n_lines, n_dropped``.

    All rows and other columns stay (with ``counts``, columns of those two names are replaced). Each row is a
    page, copies included, or each text of a host without ``copies``; pages without a host form one. Null texts stay null with 0 lines; blank lines are
    never dropped; a page whose lines all go keeps an empty text.
    """
    if counts:
        pages = pages.drop("n_lines", "n_dropped")
    own, lines, kept = spare(pages, "own", "lines", "kept")
    found = boilerplate(pages, host, text, ratio, min_pages, copies).select(F.col("host").alias(own), F.col("lines").alias(lines))
    order = pages.columns
    joined = pages.join(found, pages[host].eqNullSafe(found[own]), "left").drop(own)
    parts = F.split(F.col(text), "\n")
    clean = F.when(F.col(lines).isNull(), parts).otherwise(
        F.filter(parts, lambda x: (_line(x) == "") | ~F.array_contains(F.col(lines), _key(_line(x)))))
    out = joined.withColumn(kept, clean)
    more = []
    shown = [F.array_join(F.col(kept), "\n").alias(c) if c == text else F.col(c) for c in order]
    if counts:
        more = [F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
                F.when(F.col(text).isNull(), 0).otherwise(F.size(parts) - F.size(kept)).alias("n_dropped")]
    return out.select(*shown, *more)


def oracle_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL of ``drop_lines`` over ``documents``, as the query returns it."""
    ends = "' ' || chr(9) || chr(13)"
    return f"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT source, unnest(list_distinct(list_transform(parts, lambda x: trim(x, {ends})))) AS line FROM p),
n AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS total FROM p GROUP BY ALL),
b AS (SELECT n.source, list(line) AS lines FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source
      WHERE n >= {min_pages} AND n > {ratio} * total GROUP BY ALL),
k AS (SELECT p.doc_id, p.source, p.text, parts, CASE WHEN b.lines IS NULL THEN parts ELSE list_filter(parts,
      lambda x: trim(x, {ends}) = '' OR NOT list_contains(b.lines, trim(x, {ends}))) END AS kept
      FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(parts) - len(kept), 0) AS INTEGER) AS n_dropped
FROM k"""
