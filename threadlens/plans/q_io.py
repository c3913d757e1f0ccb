"""Registered queries: sources and sinks (A*) and streaming jobs (H*).

Each query writes data derived from the driver tables into a fresh folder under
``spark.checkpoint.dir`` and reads it back through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from threadlens.functions import text as T
from threadlens.operators import filters as B
from threadlens.operators import metrics as M
from threadlens.operators import terms as E
from threadlens.operators import threads as C
from threadlens.plans import sqlparts as S
from threadlens.plans.registry import query
from threadlens.schema import ITEM
from threadlens.session import scratch_path
from threadlens.sources import readers as RD
from threadlens.sources import sinks as SK
from threadlens.sources.fixtures import ALLOWED_CATEGORIES, comment_lines, item_texts, items, story_documents
from threadlens.sources.tables import load
from threadlens.streaming.ingest import ingest_stream, ingest_stream_stateful, process_new_stories, read_store

W = S.with_


def _item_rows(spark, sf):
    its = items(spark, sf, with_kids=True, with_descendants=True)
    return its.select(*[f.name for f in ITEM.fields])


@query("json_roundtrip", f"""
SELECT doc_id AS id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)""")
def json_roundtrip(spark, sf):
    """A6 + A15: token records written as JSON and read back with the token schema."""
    path = scratch_path(spark, "tokens")
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.tokens("text").alias("tokens"))
    SK.write_json(docs, path)
    back = RD.read_tokens(spark, path)
    return back.select("id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("category_roundtrip", W(S.COMMENT_LINES, body=f"""
SELECT subreddit AS category, count(*) AS n_lines,
       CAST(sum(length(translate(body, chr(10) || ',' || chr(13), '   '))) AS BIGINT) AS n_chars
FROM comment_lines WHERE list_contains({S.ALLOWED}, subreddit) AND body <> '[deleted]' GROUP BY subreddit"""))
def category_roundtrip(spark, sf):
    """B7 + F6 + A7 + A4: allowed categories' cleaned bodies, one folder per category, read back."""
    path = scratch_path(spark, "by_category")
    kept = B.category_filter(comment_lines(spark, sf), ALLOWED_CATEGORIES)
    SK.write_by_category(kept.select(F.col("subreddit").alias("category"),
                                     T.clean_line("body").alias("text")), path)
    back = RD.read_partitioned_text(spark, path)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n_lines"),
                                        F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("counts_csv", "SELECT DISTINCT source AS name FROM documents")
def counts_csv(spark, sf):
    """E3 + A8 + A5: category counts written as ``name,count`` CSV; the allow-list reader takes column one."""
    path = scratch_path(spark, "counts")
    SK.write_counts(M.category_counts(load(spark, sf, "documents"), "source"), path, "source")
    return RD.read_allowlist(spark, path)


@query("counts_csv_rows", "SELECT source AS name, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def counts_csv_rows(spark, sf):
    """E3 + A8: the counts as written, each with its place in the files (which follow each other in descending order)."""
    path = scratch_path(spark, "counts")
    SK.write_counts(M.category_counts(load(spark, sf, "documents"), "source"), path, "source")
    rows = spark.read.schema("name string, n long").csv(path).select("name", "n", "_metadata.file_name", F.monotonically_increasing_id().alias("at"))
    order = Window.orderBy("file_name", "at")          # one row for each category
    return rows.select("name", "n", F.row_number().over(order).cast("long").alias("place"))


@query("comments_jsonl", """
SELECT source AS subreddit, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT '<rejects>' AS subreddit, count(*) AS n FROM documents WHERE lang = 'de'""")
def comments_jsonl(spark, sf):
    """A3 + E3: a comment dump with one truncated line per German document; rejects are counted, not re-read."""
    path = scratch_path(spark, "comments")
    docs = load(spark, sf, "documents")
    good = docs.select(F.to_json(F.struct(F.col("source").alias("subreddit"), F.col("text").alias("body"))).alias("value"))
    broken = docs.where(F.col("lang") == "de").select(
        F.concat(F.lit('{"subreddit": "'), F.col("source"), F.lit('", "body": "')).alias("value"))
    good.unionByName(broken).write.mode("overwrite").text(path)
    ok, rejects = RD.read_comments_jsonl(spark, path)
    counts = ok.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(rejects.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("<rejects>").alias("subreddit"), "n"))


@query("split_files", W(S.items_cte(), body="SELECT id, type, parent FROM items"))
def split_files(spark, sf):
    """The item table rewritten as id-ordered JSON parts of 1,000 records, read back."""
    path = scratch_path(spark, "parts")
    SK.split_files(_item_rows(spark, sf), path, rows_per_file=1000, key="id", compression="gzip")
    return RD.read_items(spark, path, fmt="json").select("id", "type", "parent")


@query("split_part_sizes", W(S.items_cte(), body="""
SELECT part, count(*) AS n, min(id) AS first_id, max(id) AS last_id, 1 AS files FROM (
  SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 700 AS INTEGER) AS part FROM items) GROUP BY part"""))
def split_part_sizes(spark, sf):
    """Parts of exactly 700 records: their sizes, id ranges and files."""
    path = scratch_path(spark, "parts")
    SK.split_files(items(spark, sf, with_text=False), path, rows_per_file=700, key="id")
    back = RD.read_items(spark, path, fmt="json").withColumn("file", F.col("_metadata.file_path"))
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
                                    F.countDistinct("file").cast("int").alias("files"))


@query("vocabulary_roundtrip", W(
    f"dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY doc_id, term)",
    """stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY term),
kept AS (SELECT * FROM stats WHERE df >= 2 AND df <= 0.8 * (SELECT count(*) FROM documents)),
top30 AS (SELECT term FROM kept ORDER BY df DESC, term LIMIT 30),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_id, df, cf
          FROM (SELECT * FROM kept WHERE term NOT IN (SELECT term FROM top30) ORDER BY df DESC, term LIMIT 2000))""",
    body="SELECT term, term_id, df, cf FROM vocab"))
def vocabulary_roundtrip(spark, sf):
    """A vocabulary saved as Parquet and loaded back."""
    path = scratch_path(spark, "vocab")
    dt = E.term_frequencies(load(spark, sf, "documents"), ["doc_id"])
    SK.save_vocabulary(E.vocabulary(dt, id_col="doc_id", no_below=2, no_above=0.8, drop_top_n=30,
                                    max_features=2000, n_docs=E.n_documents(load(spark, sf, "documents"))), path)
    return spark.read.parquet(path)


def _documents(spark, sf):
    """The stories as nested JSON lines, and a copy of each story's line without its end for every 350th item."""
    path = scratch_path(spark, "documents")
    docs = story_documents(items(spark, sf, with_text=False))
    broken = docs.where(F.pmod("id", F.lit(350)) == 0).select(F.expr("substring(document, 1, length(document) - 3)").alias("value"))
    docs.select(F.col("document").alias("value")).unionByName(broken).write.text(path)
    return RD.read_thread_json(spark, path, lines=True)


@query("thread_json", W(S.items_cte(), S.tree_cte("items", "(SELECT * FROM items WHERE type = 'story')"), body="""
SELECT t.id, t.parent, t.depth, i.type, i.score, i."by", coalesce(i.dead, FALSE) AS dead
FROM tree t JOIN items i ON i.id = t.id""", recursive=True))
def thread_json(spark, sf):
    """A1: the items written as nested story documents, one a line, and unrolled again."""
    its, _ = _documents(spark, sf)
    return its.select("id", "parent", "depth", "type", "score", "by", F.coalesce("dead", F.lit(False)).alias("dead"))


@query("thread_json_rejects", W(S.items_cte(), body="""
SELECT 'items' AS kind, count(*) AS n FROM items UNION ALL
SELECT 'rejects' AS kind, count(*) AS n FROM items WHERE type = 'story' AND id % 350 = 0"""))
def thread_json_rejects(spark, sf):
    """A1: documents cut short are counted as rejects, each once."""
    its, rejects = _documents(spark, sf)
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(its, "items").unionByName(count(rejects, "rejects"))


def _land(spark, sf, folder):
    """Two crawl rounds: every item, then the stories again (an overlapping re-fetch)."""
    rows = _item_rows(spark, sf)
    for part, rows in (("round1", rows), ("round2", rows.where(F.col("type") == "story"))):
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{part}")


@query("ingest_stream", W(S.items_cte(), body="SELECT id, type, parent, md5(text) AS text_md5 FROM items"))
def ingest_stream_q(spark, sf):
    """H1: landed JSON files streamed into the item store, each id exactly once (run twice: no change)."""
    base = scratch_path(spark, "ingest")
    _land(spark, sf, f"{base}/landing")
    for _ in range(2):
        ingest_stream(spark, f"{base}/landing/*", f"{base}/store", f"{base}/checkpoint")
    store = spark.read.schema(ITEM).parquet(f"{base}/store")
    return store.select("id", "type", "parent", F.md5("text").alias("text_md5"))


@query("ingest_partitioned", W(S.items_cte(), body="""
SELECT id, type, parent, CAST(id // 500 AS BIGINT) AS id_part, md5(text) AS text_md5 FROM items"""))
def ingest_partitioned_q(spark, sf):
    """H1 into a store partitioned by id range: two overlapping landings, run twice."""
    base = scratch_path(spark, "ingest")
    _land(spark, sf, f"{base}/landing")
    for _ in range(2):
        ingest_stream(spark, f"{base}/landing/*", f"{base}/store", f"{base}/checkpoint", ids_per_part=500)
    store = read_store(spark, f"{base}/store", ITEM, ids_per_part=500)
    return store.select("id", "type", "parent", "id_part", F.md5("text").alias("text_md5"))


_STORY_WORDS = W(S.items_cte(descendants=True), "story_roots AS (SELECT * FROM items WHERE type = 'story')",
                 S.tree_cte("items", "story_roots"), f"""story_terms AS (
  SELECT t.root_id, unnest({S.tokens_freq('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE))""", body="""
SELECT root_id AS id, count(DISTINCT term) AS n_words, count(*) AS n_tokens FROM story_terms GROUP BY root_id""",
                 recursive=True)


@query("process_new_stories", _STORY_WORDS)
def process_new_stories_q(spark, sf):
    """H2: word frequencies computed once per newly landed story (overlapping rounds, two runs)."""
    base = scratch_path(spark, "stories")
    _land(spark, sf, f"{base}/landing")
    its, texts = items(spark, sf, text_apart=True), item_texts(spark, sf)
    out_schema = "id bigint, word string, freq bigint"

    def word_freq_of(stories):
        rows = C.comment_corpus(its, stories.select("id", "parent", "type"), texts)
        return E.word_freq(rows, ["root_id"], tokenizer=T.tokens_freq, together=True) \
                .select(F.col("root_id").alias("id"), "word", F.col("freq").cast("bigint").alias("freq"))

    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(out_schema)
    for _ in range(2):
        process_new_stories(spark, f"{base}/landing/*", f"{base}/out", f"{base}/checkpoint",
                            word_freq_of, schema)
    out = spark.read.schema(schema).parquet(f"{base}/out")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("freq").cast("bigint").alias("n_tokens"))


@query("term_freq_csv", W(S.items_cte(descendants=True),
                          "story_roots AS (SELECT * FROM items WHERE type = 'story' AND descendants > 0)",
                          S.tree_cte("items", "story_roots"), f"""story_terms AS (
  SELECT t.root_id, unnest({S.tokens_freq('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE))""", body="""
SELECT root_id AS id, count(DISTINCT term) AS n_words, count(*) AS n_tokens FROM story_terms GROUP BY root_id""",
                          recursive=True))
def term_freq_csv(spark, sf):
    """§3.3 job: the (Word, Freq, Id) rows of all stories with comments appended to one CSV."""
    path = scratch_path(spark, "term_freq")
    its = items(spark, sf, with_descendants=True, text_apart=True)
    stories = B.min_descendants(its.where(F.col("type") == "story"), 0)
    rows = C.comment_corpus(its, stories, item_texts(spark, sf))
    wf = E.word_freq(rows, ["root_id"], tokenizer=T.tokens_freq, together=True).withColumnRenamed("root_id", "id")
    SK.append_term_freq(wf, path, "csv", compression="gzip")
    back = spark.read.schema("Word string, Freq bigint, Id bigint").csv(path)
    return back.groupBy(F.col("Id").alias("id")).agg(F.count(F.lit(1)).alias("n_words"),
                                                     F.sum("Freq").cast("bigint").alias("n_tokens"))


@query("ingest_stream_stateful", W(S.items_cte(), body="SELECT id, type, parent, md5(text) AS text_md5 FROM items"))
def ingest_stream_stateful_q(spark, sf):
    """H1 (stateful): duplicate ids across landed files dropped in watermarked streaming state."""
    base = scratch_path(spark, "ingest_state")
    _land(spark, sf, f"{base}/landing")
    ingest_stream_stateful(spark, f"{base}/landing/*", f"{base}/store", f"{base}/checkpoint")
    store = spark.read.schema(ITEM).parquet(f"{base}/store")
    return store.select("id", "type", "parent", F.md5("text").alias("text_md5"))


T_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()),
                       StructField("n_chars", LongType())])


@query("merge_csv_parts", "SELECT doc_id, lang, n_chars FROM documents")
def merge_csv_parts(spark, sf):
    """Document rows written as several ISO-8859-1 CSV parts plus a part of malformed lines
    (non-numeric sizes for the German documents); the merge drops exactly the malformed lines."""
    path = scratch_path(spark, "csv_parts")
    docs = load(spark, sf, "documents")
    good = docs.select("doc_id", "lang", F.col("n_chars").cast("string").alias("n_chars"))
    bad = docs.where(F.col("lang") == "de").select("doc_id", "lang", F.lit("n/a").alias("n_chars"))
    good.repartition(4).write.mode("overwrite").option("encoding", "ISO-8859-1").csv(f"{path}/good")
    bad.write.mode("overwrite").option("encoding", "ISO-8859-1").csv(f"{path}/bad")
    return RD.merge_csv_parts(spark, f"{path}/*/*.csv", T_SCHEMA)


@query("merge_csv_counts", """
SELECT 'good' AS kind, count(*) AS n FROM documents
UNION ALL SELECT 'rejects' AS kind, count(*) AS n FROM documents WHERE lang = 'de'
UNION ALL SELECT 'ids' AS kind, count(*) AS n FROM documents
UNION ALL SELECT 'store' AS kind, count(DISTINCT doc_id) AS n FROM documents""")
def merge_csv_counts(spark, sf):
    """Counts of good and rejected lines, of a one-column read, and of a store that took the parts twice."""
    path = scratch_path(spark, "csv_parts")
    docs = load(spark, sf, "documents")
    good = docs.select("doc_id", "lang", F.col("n_chars").cast("string").alias("n_chars"))
    bad = docs.where(F.col("lang") == "de").select("doc_id", "lang", F.lit("n/a").alias("n_chars"))
    good.unionByName(bad).write.option("encoding", "ISO-8859-1").csv(path)
    ok, rejects = RD.read_csv_with_rejects(spark, path, T_SCHEMA)
    store = scratch_path(spark, "store")
    for _ in range(2):
        RD.append_new(ok, store, "doc_id")
    parts = {"good": ok, "rejects": rejects, "ids": ok.select("doc_id"), "store": spark.read.parquet(store)}
    counts = [d.select(F.lit(k).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")) for k, d in parts.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
