"""Views that adapt the driver tables to the item data model.

``items``: blocks of ``BLOCK`` consecutive event ids form one story and its comment
tree, laid out as a binary heap (position ``r`` in the block has parent position
``(r - 1) // 2``), so every parent id is smaller than its children's ids. Each item
carries the whole text of one document (``event_id mod n_documents``) and each story
the whole text of one ``benchmark`` passage as its title, so text volume grows with
both tables. The same view is written in SQL for the DuckDB oracle
(``threadlens.plans.sqlparts.items_cte``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.sources.tables import load

BLOCK = 50

# Fixed fixture constants (shared with the SQL twin).
TEXTLESS_MOD = 97      # every 97th item has no text
DELETED_MOD = 31       # every 31st comment is deleted
DEAD_EVENT = "error"   # comments from 'error' events are dead

#: Items whose texts one task attaches (a text has a few KB), and the most tasks this makes.
TEXTS_A_TASK = 4_000
MOST_TASKS = 20_000


def _id_space(df: DataFrame, col: str) -> Column:
    """Size of a contiguous id space (max + 1), as a scalar subquery inside the plan."""
    return df.select(F.greatest(F.coalesce(F.max(col) + 1, F.lit(1)), F.lit(1))).scalar()


def _flag(cond: Column, presence: bool) -> Column:
    return F.when(cond, F.lit(True)) if presence else cond


def items(spark: SparkSession, sf_dir: str, *, presence: bool = False, with_text: bool = True,
          with_kids: bool = False, with_descendants: bool = False, text_apart: bool = False) -> DataFrame:
    """Item table (stories and comments) derived from ``events``, ``documents``, ``benchmark``.

    ``presence=True`` leaves ``dead``/``deleted`` null instead of false, for the
    key-absent semantics of :func:`threadlens.operators.filters.live`.
    ``with_text=False`` skips the document join for structure-only plans. With ``text_apart`` an item has
    ``text_key`` instead of its text (null where it has none), which stands in :func:`item_texts`.
    """
    events = load(spark, sf_dir, "events")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    bench = load(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("title"))
    n_docs = _id_space(docs, "doc_id") if with_text or text_apart else F.lit(1)
    with_text = with_text and not text_apart
    n_bench = _id_space(bench, "item_id")

    r = F.pmod(F.col("event_id"), F.lit(BLOCK))
    base = events.select(
        F.col("event_id").alias("id"),
        F.when(r == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("event_id") - r + F.floor((r - 1) / 2).cast("bigint")).alias("parent"),
        F.when(r == 0, F.lit("story")).otherwise(F.lit("comment")).alias("type"),
        F.unix_timestamp(F.col("ts")).alias("time"),
        F.col("user_id").cast("string").alias("by"),
        F.floor(F.col("value")).cast("bigint").alias("score"),
        _flag((F.col("event_type") == F.lit(DEAD_EVENT)) & (r != 0), presence).alias("dead"),
        _flag((F.pmod(F.col("event_id"), F.lit(DELETED_MOD)) == 0) & (r != 0), presence).alias("deleted"),
        F.pmod(F.col("event_id"), n_docs).alias("_doc_key"),
        F.when(r == 0, F.pmod(F.floor(F.col("event_id") / BLOCK).cast("bigint"), n_bench))
         .alias("_title_key"),
        F.floor(F.col("event_id") / BLOCK).cast("bigint").alias("_block"),
        (F.pmod(F.col("event_id"), F.lit(TEXTLESS_MOD)) == 0).alias("_textless"),
    )
    if with_text:
        # the events are one small file, so one task would attach (and later tokenize) every text: spread the narrow rows first
        tasks = max(-(-events.count() // TEXTS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
        base = base.repartition(min(tasks, MOST_TASKS), "_doc_key")      # by the join's key: no second shuffle of either side
        out = base.join(docs, base["_doc_key"] == docs["doc_id"], "left")
    else:
        out = base.withColumn("text", F.lit(None).cast("string")).withColumn("text_key", F.when(~F.col("_textless"), F.col("_doc_key")))
    out = (out
           .join(bench, out["_title_key"] == bench["item_id"], "left")
           .withColumn("text", F.when(F.col("_textless"), F.lit(None).cast("string"))
                       .otherwise(F.col("text")))
           .withColumn("url", F.when(F.col("type") == "story",
                                     F.concat(F.lit("https://news.example/item/"), F.col("id").cast("string")))))
    cols = ["id", "type", "title"] + (["text"] if with_text else ["text_key"] if text_apart else []) + \
        ["parent", "time", "by", "score", "url", "deleted", "dead"]
    if with_descendants:
        sizes = events.groupBy(F.floor(F.col("event_id") / BLOCK).cast("bigint").alias("_blk")) \
                      .agg(F.count(F.lit(1)).alias("_n"))
        out = (out.join(sizes, out["_block"] == sizes["_blk"], "left")
                  .withColumn("descendants", F.when(F.col("type") == "story", F.col("_n") - 1)))
        cols.append("descendants")
    out = out.select(*cols)
    if with_kids:
        # Heap layout: the kids of block position r are positions 2r+1 and 2r+2 of
        # the same block, when those events exist (event ids are contiguous). A
        # per-row rule, so no parent's children are ever gathered by a group-by.
        top = events.select(F.max("event_id")).scalar()
        r = F.pmod(F.col("id"), F.lit(BLOCK))
        first, second = F.col("id") + r + 1, F.col("id") + r + 2
        has_first = (2 * r + 1 < BLOCK) & (first <= top)
        has_second = (2 * r + 2 < BLOCK) & (second <= top)
        out = out.withColumn("kids", F.when(has_second, F.array(first, second))
                                      .when(has_first, F.array(first)))
    return out


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text_key, text)``: the texts that items with ``text_apart`` name."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_key"), "text")


# Fixed fixture constants for the category pipeline: 16 allowed categories,
# and documents whose id is a multiple of 37 stand for '[deleted]' bodies.
ALLOWED_CATEGORIES = [f"src{i}" for i in range(16)]
DELETED_BODY_MOD = 37
DELETED_BODY = "[deleted]"


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a comment dump: ``(id, subreddit, body)``."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("subreddit"),
        F.when(F.pmod(F.col("doc_id"), F.lit(DELETED_BODY_MOD)) == 0, F.lit(DELETED_BODY))
         .otherwise(F.col("text")).alias("body"),
    )


def story_documents(items: DataFrame) -> DataFrame:
    """``(id, document)``: each story as one nested JSON document, its ``kids`` inside their parents.

    Built from the deepest level of the heap layout upwards; a parent has at most two kids, so nothing large is gathered.
    """
    r = F.pmod(F.col("id"), F.lit(BLOCK))
    level = F.floor(F.log2(r + 1)).cast("int")
    own = F.to_json(F.struct("id", "type", "by", "time", "score", "parent", "dead", "deleted"))
    nodes = items.select("id", "parent", level.alias("level"), F.regexp_replace(own, "}$", "").alias("open"))
    below = None
    for d in range(BLOCK.bit_length() - 1, -1, -1):
        here = nodes.where(F.col("level") == d)
        if below is None:
            below = here.select("id", "parent", F.concat("open", F.lit("}")).alias("document"))
            continue
        kids = below.groupBy(F.col("parent").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("id", "document"))).alias("_k"))
        inside = F.concat(F.lit(',"kids":['), F.array_join("_k.document", ","), F.lit("]}"))
        below = here.join(kids, here["id"] == kids["_p"], "left").select(
            "id", "parent", F.concat("open", F.coalesce(inside, F.lit("}"))).alias("document"))
    return below.select("id", "document")
