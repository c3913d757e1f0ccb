"""Registered queries: item filters (B*) and thread operators (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.text import unescape_html
from threadlens.operators import filters as B
from threadlens.operators import threads as C
from threadlens.operators.ranking import top_n
from threadlens.plans import sqlparts as S
from threadlens.plans.registry import query
from threadlens.sources.fixtures import ALLOWED_CATEGORIES, comment_lines, item_texts, items
from threadlens.sources.tables import load

W = S.with_
IT = S.items_cte()


# ---------------------------------------------------------------- B: filters
@query("live_items", W(IT, body=f"SELECT id, type, parent FROM items WHERE {S.LIVE}"))
def live_items(spark, sf):
    return B.live(items(spark, sf, with_text=False)).select("id", "type", "parent")


@query("live_items_exists", W(S.items_cte(presence=True),
                              body="SELECT id, type, parent FROM items WHERE deleted IS NULL AND dead IS NULL"))
def live_items_exists(spark, sf):
    return B.live(items(spark, sf, presence=True, with_text=False), "exists").select("id", "type", "parent")


@query("live_stories", W(IT, body=f"SELECT id, score, md5(title) AS title_md5 FROM items "
                                  f"WHERE {S.LIVE} AND type = 'story' AND title IS NOT NULL"))
def live_stories(spark, sf):
    return B.stories(B.live(items(spark, sf, with_text=False))) \
            .select("id", "score", F.md5("title").alias("title_md5"))


@query("id_range", W(IT, body="SELECT id, type FROM items WHERE id >= 2500 AND id < 7500"))
def id_range(spark, sf):
    return B.id_range(items(spark, sf, with_text=False), 2500, 7500, "[)").select("id", "type")


@query("by_author", W(IT, body="SELECT id, type, score FROM items WHERE \"by\" = '42'"))
def by_author(spark, sf):
    return B.by_author(items(spark, sf, with_text=False), "42").select("id", "type", "score")


@query("min_descendants", W(S.items_cte(descendants=True),
                            body="SELECT id, descendants FROM items WHERE type = 'story' AND descendants > 30"))
def min_descendants(spark, sf):
    its = items(spark, sf, with_text=False, with_descendants=True)
    return B.min_descendants(its.where(F.col("type") == "story"), 30).select("id", "descendants")


@query("cap_kids", W(S.items_cte(kids=True), body="""
SELECT id, len(k) AS n_kids, array_to_string(k, ',') AS kids_str
FROM (SELECT id, list_filter(kids, lambda x: x < 5000) AS k FROM items WHERE kids IS NOT NULL)"""))
def cap_kids(spark, sf):
    its = items(spark, sf, with_text=False, with_kids=True).where(F.col("kids").isNotNull())
    capped = B.cap_kids(its, 5000)
    return capped.select("id", F.size("kids").alias("n_kids"),
                         F.array_join(F.transform("kids", lambda x: x.cast("string")), ",").alias("kids_str"))


@query("project_story", W(S.items_cte(descendants=True), body=f"""
SELECT title, score, descendants, id, url FROM items
WHERE {S.LIVE} AND type = 'story' AND title IS NOT NULL"""))
def project_story(spark, sf):
    its = items(spark, sf, with_text=False, with_descendants=True)
    return B.project_story(B.stories(B.live(its)))


@query("ids_in", W(IT, body="SELECT id, type FROM items WHERE id IN (SELECT doc_id FROM labels)"))
def ids_in(spark, sf):
    return B.ids_in(items(spark, sf, with_text=False), load(spark, sf, "labels"), ids_col="doc_id") \
            .select("id", "type")


@query("category_filter", W(S.COMMENT_LINES, body=f"""
SELECT id, subreddit FROM comment_lines
WHERE list_contains({S.ALLOWED}, subreddit) AND body <> '[deleted]'"""))
def category_filter(spark, sf):
    return B.category_filter(comment_lines(spark, sf), ALLOWED_CATEGORIES).select("id", "subreddit")


@query("single_reply_comments", W(S.items_cte(kids=True), body="""
SELECT c.id, c.parent FROM items c
WHERE c.type = 'comment' AND len(coalesce(c.kids, [])) = 1
  AND c.parent IN (SELECT id FROM items WHERE type = 'story')"""))
def single_reply_comments(spark, sf):
    return B.single_reply_comments(items(spark, sf, with_text=False, with_kids=True)).select("id", "parent")


@query("single_live_reply", W(S.items_cte(), f"live AS (SELECT * FROM items WHERE {S.LIVE})", body="""
SELECT c.id, c.parent FROM live c WHERE c.type = 'comment' AND c.parent IN (SELECT id FROM live WHERE type = 'story')
  AND (SELECT count(*) FROM live k WHERE k.parent = c.id) = 1"""))
def single_live_reply(spark, sf):
    """B1 + B10: first-level comments with exactly one kid among the live items (whose ``kids`` are drawn anew)."""
    live = B.live(items(spark, sf, with_text=False))
    kids = live.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_p")).agg(
        F.when(F.count("id") == 1, F.array(F.min("id"))).otherwise(F.array(F.min("id"), F.max("id"))).alias("kids"))      # the first and the last
    linked = live.join(kids, live["id"] == kids["_p"], "left").drop("_p")
    return B.single_reply_comments(linked).select("id", "parent")


@query("admit_kids", W(S.items_cte(kids=True), body="""
SELECT p.id AS parent, k.kid FROM items p, unnest(p.kids) AS k(kid)
JOIN items c ON c.id = k.kid
WHERE c.type = 'comment' AND NOT coalesce(c.deleted, FALSE)"""))
def admit_kids(spark, sf):
    return B.admit_kids(items(spark, sf, with_text=False, with_kids=True))


# ---------------------------------------------------------------- C: threads
_LIVE_NODES = f"live_nodes AS (SELECT * FROM items WHERE {S.LIVE})"
_LIVE_ROOTS = "live_roots AS (SELECT * FROM live_nodes WHERE type = 'story')"
_ROOTS = "story_roots AS (SELECT * FROM items WHERE type = 'story')"


@query("assemble_threads", W(IT, _LIVE_NODES, _LIVE_ROOTS, S.tree_cte("live_nodes", "live_roots"),
                             body=f"SELECT root_id, id, parent, depth, {S.PATH_STR} AS path FROM tree",
                             recursive=True))
def assemble_threads(spark, sf):
    tree = C.assemble_threads(items(spark, sf, with_text=False))
    return tree.select("root_id", "id", "parent", "depth", C.path_string().alias("path"))


@query("thread_roots_doubling", W(IT, _LIVE_NODES, _LIVE_ROOTS, S.tree_cte("live_nodes", "live_roots"),
                                  body="SELECT root_id, id, parent, depth FROM tree", recursive=True))
def thread_roots_doubling(spark, sf):
    """C1 by pointer doubling (log2(depth) joins): root and depth of every node of a live thread."""
    return C.thread_roots(items(spark, sf, with_text=False))


@query("link_forest", W(IT, _LIVE_NODES, body="""
SELECT n.id, p.id AS parent, p.id IS NULL AS is_root,
       (SELECT count(*) FROM live_nodes c WHERE c.parent = n.id) AS n_children
FROM live_nodes n LEFT JOIN live_nodes p ON p.id = n.parent"""))
def link_forest(spark, sf):
    return C.link_forest(items(spark, sf, with_text=False))


@query("comment_depth", W(IT, _ROOTS, S.tree_cte("items", "story_roots"), body="""
SELECT t.root_id, t.id, t.depth, md5(repeat(chr(9), t.depth) || i.text) AS indented_md5
FROM tree t JOIN items i ON i.id = t.id""", recursive=True))
def comment_depth(spark, sf):
    return C.comment_depth(items(spark, sf, text_apart=True), item_texts(spark, sf)).select(
        "root_id", "id", "depth", F.md5("indented").alias("indented_md5"))


@query("leaf_corpus", W(IT, _ROOTS, S.tree_cte("items", "story_roots"), body=f"""
SELECT t.root_id, t.id, 'title' AS part, {S.PATH_STR} AS path, md5(i.title) AS text_md5
FROM tree t JOIN items i ON i.id = t.id WHERE t.depth = 0 AND i.title IS NOT NULL
UNION ALL
SELECT t.root_id, t.id, 'leaf' AS part, {S.PATH_STR} AS path, md5(i.text) AS text_md5
FROM tree t JOIN items i ON i.id = t.id
WHERE t.depth > 0 AND i.type = 'comment' AND i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE)
  AND NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent = t.id AND c.depth > 0)""", recursive=True))
def leaf_corpus(spark, sf):
    return C.leaf_corpus(items(spark, sf, text_apart=True), item_texts(spark, sf)).select(
        "root_id", "id", "part", C.path_string().alias("path"), F.md5("text").alias("text_md5"))


@query("comment_corpus", W(IT, _ROOTS, S.tree_cte("items", "story_roots"), body="""
SELECT t.root_id, t.id, t.depth, md5(i.text) AS text_md5
FROM tree t JOIN items i ON i.id = t.id
WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE)""", recursive=True))
def comment_corpus(spark, sf):
    return C.comment_corpus(items(spark, sf, text_apart=True), texts=item_texts(spark, sf)).select("root_id", "id", "depth", F.md5("text").alias("text_md5"))


@query("thread_text_once", W(IT, _LIVE_NODES, _LIVE_ROOTS, S.tree_cte("live_nodes", "live_roots"), body="""
SELECT t.root_id, t.id, 1 AS copies, md5(i.text) AS text_md5
FROM tree t JOIN items i ON i.id = t.id WHERE i.text IS NOT NULL AND i.text <> ''""", recursive=True))
def thread_text_once(spark, sf):
    return C.thread_text(items(spark, sf, text_apart=True), "once", texts=item_texts(spark, sf)).select(
        "root_id", "id", "copies", F.md5("text").alias("text_md5"))


@query("thread_text_legacy", W(IT, _LIVE_NODES, _LIVE_ROOTS, S.tree_cte("live_nodes", "live_roots"), body="""
SELECT root_id, id, CASE WHEN nk = 0 THEN 1 ELSE nk END AS copies, text_md5 FROM (
  SELECT t.root_id, t.id, (SELECT count(*) FROM tree c WHERE c.parent = t.id AND c.depth > 0) AS nk,
         md5(i.text) AS text_md5
  FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND i.text <> '' AND t.root_id IN (SELECT root_id FROM tree WHERE depth > 0))""",
    recursive=True))
def thread_text_legacy(spark, sf):
    return C.thread_text(items(spark, sf, text_apart=True), "legacy", texts=item_texts(spark, sf)).select(
        "root_id", "id", "copies", F.md5("text").alias("text_md5"))


_ALL_ROOTS = "all_roots AS (SELECT * FROM items WHERE parent IS NULL OR parent NOT IN (SELECT id FROM items))"
_DESC = W(IT, _ALL_ROOTS, S.tree_cte("items", "all_roots"), """anc AS (
  SELECT unnest(path[1:depth]) AS ancestor FROM tree WHERE depth > 0
), cnt AS (SELECT ancestor, count(*) AS n FROM anc GROUP BY ancestor)""",
          body="SELECT t.id, coalesce(c.n, 0) AS descendants FROM tree t LEFT JOIN cnt c ON c.ancestor = t.id",
          recursive=True)


@query("descendant_counts", _DESC)
def descendant_counts(spark, sf):
    return C.descendant_counts(items(spark, sf, with_text=False)).select("id", "descendants")


@query("top_comments", W(IT, _ALL_ROOTS, S.tree_cte("items", "all_roots"), """anc AS (
  SELECT unnest(path[1:depth]) AS ancestor FROM tree WHERE depth > 0
), cnt AS (SELECT ancestor, count(*) AS n FROM anc GROUP BY ancestor)""", body=f"""
SELECT t.id, md5({S.unescape('i.text')}) AS text_md5, c.n AS descendants
FROM tree t JOIN cnt c ON c.ancestor = t.id JOIN items i ON i.id = t.id
WHERE t.depth > 0 AND c.n > 10""", recursive=True))
def top_comments(spark, sf):
    return C.top_comments(items(spark, sf, text_apart=True), 10, item_texts(spark, sf)).select(
        "id", F.md5("text").alias("text_md5"), "descendants")


@query("not_yet_processed", W(IT, body=f"""
SELECT id FROM items WHERE {S.LIVE} AND type = 'story' AND title IS NOT NULL
  AND id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""))
def not_yet_processed(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    return C.not_yet_processed(st, load(spark, sf, "labels"), "doc_id").select("id")


@query("pick_listed", W(IT, body=f"""
SELECT position, id, score FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS position
  FROM items WHERE {S.LIVE} AND type = 'story' AND title IS NOT NULL
) WHERE position <= 100"""))
def pick_listed(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    ranked = top_n(st.select("id", "score"), 100, "score")
    # positions are numbered over the bounded top-100 list only
    from pyspark.sql import Window
    ranked = ranked.withColumn("position", F.row_number().over(
        Window.orderBy(F.col("score").desc(), F.col("id"))))
    return C.pick_listed(st, ranked.select("id", "position")).select("position", "id", "score")
