"""C*: thread operators over the parent-pointer forest.

Threads are kept flat: one row per node with ``root_id``, ``depth`` and ``path``
(ids from the root down to the node). Thread assembly is a level loop: each
round equi-joins the current frontier with the ``(id, parent)`` edge list, so a
story with a million comments costs one shuffle join per level, not one lookup
per comment. Each level is cut from the lineage by writing it
into ``spark.checkpoint.dir`` (a Parquet table per level) so a lost executor
re-reads it instead of recomputing all earlier levels.

Items carry their text, or (``texts`` given) a ``text_key`` into a table ``(text_key, text)``. Then
everything above is done on narrow rows, and texts are attached last: no text is shuffled with its item.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import unescape_html
from threadlens.operators.filters import live
from threadlens.session import materialize, text_tasks

TREE_COLS = ["root_id", "id", "parent", "depth", "path"]


class ThreadCycleError(RuntimeError):
    pass


def roots_of(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is null or not present in ``nodes``."""
    present = nodes.select(F.col("id").alias("_pid"))
    return nodes.join(present, nodes["parent"] == present["_pid"], "left_anti")


def assemble_threads(items: DataFrame, roots: DataFrame | None = None, *, prune: bool = True,
                     live_mode: str = "falsy", max_depth: int = 10_000) -> DataFrame:
    """Flatten each thread below ``roots`` into ``(root_id, id, parent, depth, path)``.

    With ``prune=True`` a deleted or dead node removes its whole subtree (it never
    enters the edge list, so nothing below it is reached). ``roots`` defaults to
    the live stories; pass any DataFrame with an ``id`` column. Raises
    :class:`ThreadCycleError` when a node repeats on its own path and
    ``RuntimeError`` when ``max_depth`` is exceeded.
    """
    nodes = live(items, live_mode) if prune else items
    if roots is None:
        roots = nodes.where(F.col("type") == "story")
    elif prune:
        roots = roots.join(nodes.select(F.col("id").alias("_lid")), roots["id"] == F.col("_lid"),
                           "left_semi")
    edges = (nodes.where(F.col("parent").isNotNull())
                  .select(F.col("id"), F.col("parent"))
                  .persist(StorageLevel.MEMORY_AND_DISK))
    level = materialize(roots.select(F.col("id").alias("root_id"), F.col("id"),
                                     F.col("parent").cast("bigint").alias("parent"),
                                     F.lit(0).alias("depth"), F.array(F.col("id")).alias("path")), "level")
    parts = [level]
    try:
        for depth in range(1, max_depth + 2):
            front = level.select(F.col("id").alias("_fid"), "root_id", "path")
            nxt = materialize(
                edges.join(front, edges["parent"] == front["_fid"], "inner")
                     .select("root_id", "id", "parent", F.lit(depth).alias("depth"),
                             F.concat(F.col("path"), F.array(F.col("id"))).alias("path"),
                             F.array_contains(F.col("path"), F.col("id")).alias("_cycle")), "level")
            # one small job per level: the frontier size and whether a node repeats on its path
            n_rows, n_cycles = nxt.agg(F.count(F.lit(1)), F.sum(F.col("_cycle").cast("int"))).first()
            if n_rows == 0:
                break
            if n_cycles:
                raise ThreadCycleError("parent pointers form a cycle below a root")
            if depth > max_depth:
                raise RuntimeError(f"thread deeper than max_depth={max_depth}")
            level = nxt.drop("_cycle")
            parts.append(level)
    finally:
        edges.unpersist()
    return reduce(lambda a, b: a.unionByName(b), parts)


def path_string(col: str = "path"):
    """Render a path as ``'id/id/id'`` (for output and comparison)."""
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), "/")


def link_forest(items: DataFrame, upper: int | None = None, live_mode: str = "falsy") -> DataFrame:
    """Attach each live item to its parent when the parent is present, else make it a root.

    ``upper`` drops items with ``id >= upper`` (the kid cap of the reference).
    Output ``(id, parent, is_root, n_children)``; every child is kept.
    """
    nodes = live(items, live_mode)
    if upper is not None:
        nodes = nodes.where(F.col("id") < upper)
    nodes = nodes.select("id", "parent")
    present = nodes.select(F.col("id").alias("_pid"))
    linked = (nodes.join(present, nodes["parent"] == present["_pid"], "left")
                   .select("id", F.col("_pid").alias("parent")))
    counts = linked.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("_cid")) \
                   .agg(F.count(F.lit(1)).alias("n_children"))
    return (linked.join(counts, linked["id"] == counts["_cid"], "left")
                  .select("id", "parent", F.col("parent").isNull().alias("is_root"),
                          F.coalesce(F.col("n_children"), F.lit(0)).alias("n_children")))


def attach_text(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``n`` rows with ``text`` instead of ``text_key`` (null where the key is null or unknown)."""
    side = texts.select(F.col("text_key").alias("_tk"), "text")
    dealt = rows.repartition(text_tasks(rows, n), "text_key")
    return dealt.join(side, dealt["text_key"] == side["_tk"], "left").drop("_tk", "text_key")


def with_text(tree: DataFrame, items: DataFrame, cols=("type", "text", "dead", "deleted"), texts: DataFrame | None = None) -> DataFrame:
    """Join item fields onto tree rows by id (one shuffle, after the loop).

    The tree's narrow rows are what is held in a hash table, so items with their texts inside are shuffled but not sorted.
    """
    apart = texts is not None and "text" in cols
    side = items.select(F.col("id").alias("_iid"), *["text_key" if apart and c == "text" else c for c in cols])
    held = tree if apart or "text" not in cols else tree.hint("shuffle_hash")
    rows = held.join(side, tree["id"] == side["_iid"], "inner").drop("_iid")
    return attach_text(rows, texts, tree.count()) if apart else rows


def child_counts(tree: DataFrame) -> DataFrame:
    """Number of children of each tree node present in ``tree``: ``(id, n_kids)``."""
    return tree.where(F.col("depth") > 0).groupBy(F.col("parent").alias("id")) \
               .agg(F.count(F.lit(1)).alias("n_kids"))


def leaf_corpus(items: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Per story, its title and the text of its live leaf comments, in thread order.

    Dead inner nodes do not prune (the walk is unpruned); a leaf that is dead, or
    not a comment, or has no text, contributes nothing. Long form
    ``(root_id, id, depth, path, part, text)``; ``part`` is ``title`` or ``leaf``.
    Sorting by ``path`` gives the reading order; concatenation is left to the
    consumer so no story's text is gathered into a single row.
    """
    story = items.where(F.col("type") == "story")
    tree = assemble_threads(items, roots=story, prune=False)
    parents = tree.where(F.col("depth") > 0).select(F.col("parent").alias("_p")).distinct()
    leaves = tree.join(parents, tree["id"] == parents["_p"], "left_anti").where(F.col("depth") > 0)
    leaves = with_text(leaves, items, texts=texts).where(
        (F.col("type") == "comment") & F.col("text").isNotNull()
        & ~F.coalesce(F.col("dead"), F.lit(False)))
    titles = with_text(tree.where(F.col("depth") == 0), items, cols=("title",)) \
        .where(F.col("title").isNotNull())
    cols = ["root_id", "id", "depth", "path"]
    return (titles.select(*cols, F.lit("title").alias("part"), F.col("title").alias("text"))
            .unionByName(leaves.select(*cols, F.lit("leaf").alias("part"), "text")))


def comment_corpus(items: DataFrame, stories: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """C4: every text below a story, the story's own text included.

    Unpruned walk; ``dead`` hides only the node's own text, never its replies.
    Output ``(root_id, id, depth, text)``.
    """
    roots = stories if stories is not None else items.where(F.col("type") == "story")
    tree = assemble_threads(items, roots=roots, prune=False)
    rows = with_text(tree, items, texts=texts)
    return rows.where(F.col("text").isNotNull() & ~F.coalesce(F.col("dead"), F.lit(False))) \
               .select("root_id", "id", "depth", "text")


def thread_text(items: DataFrame, weight: str = "once", live_mode: str = "falsy",
                roots: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """All text of each live thread (pruned walk), one row per text with ``copies``.

    ``once``: every text counts once, the root's own text included. ``legacy``:
    an inner node's text counts once per admitted kid and a kidless node's text
    once; stories without kids are skipped. Output ``(root_id, id, depth, copies, text)``.
    """
    tree = assemble_threads(items, roots=roots, prune=True, live_mode=live_mode)
    if weight == "once":
        rows = with_text(tree, items, cols=("text",), texts=texts)
        return rows.where(F.col("text").isNotNull() & (F.col("text") != "")) \
                   .select("root_id", "id", "depth", F.lit(1).alias("copies"), "text")
    if weight != "legacy":
        raise ValueError(f"unknown weight {weight!r}")
    kids = child_counts(tree)
    rows = tree.join(kids, "id", "left")
    with_kids = tree.where(F.col("depth") > 0).select(F.col("root_id").alias("_rid")).distinct()
    rows = rows.join(with_kids, rows["root_id"] == with_kids["_rid"], "left_semi")
    rows = with_text(materialize(rows.select("root_id", "id", "depth", "n_kids"), "copies"), items, cols=("text",), texts=texts)
    return (rows.where(F.col("text").isNotNull() & (F.col("text") != ""))
                .select("root_id", "id", "depth",
                        F.coalesce(F.col("n_kids"), F.lit(1)).alias("copies"), "text"))


def descendant_counts(items: DataFrame) -> DataFrame:
    """``(id, root_id, depth, descendants)``, the number of nodes below each node (unpruned tree).

    Counts are summed by pointer doubling: after round k a node has the nodes less than 2^k levels below it, and adds the
    counts of those that lie exactly 2^k levels below. Each round is one grouped sum (a hot node is combined
    map-side) and joins over rows of fixed width, so neither a chain nor a star costs more. A cycle, also one
    that no root reaches, raises :class:`ThreadCycleError`.
    """
    flat = items.select("id", "parent", F.lit(None).cast("string").alias("type"),
                        F.lit(None).cast("boolean").alias("deleted"), F.lit(None).cast("boolean").alias("dead"))
    tree = materialize(thread_roots(flat, prune=False, story_roots=False), "tree")
    levels = tree.agg(F.max("depth")).first()[0] or 0
    state = tree.select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("n"))
    reach = 1
    while reach <= levels:
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("_id")).agg(F.sum("n").alias("_n"))
        hop = state.select(F.col("id").alias("_hid"), F.col("up").alias("_up"))
        state = materialize(
            state.join(below, state["id"] == below["_id"], "left").join(hop, state["up"] == hop["_hid"], "left")
                 .select("id", F.col("_up").alias("up"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "counts")
        reach *= 2
    counts = state.select(F.col("id").alias("_id"), (F.col("n") - 1).alias("descendants"))
    return tree.join(counts, tree["id"] == counts["_id"]).select("id", "root_id", "depth", "descendants")


def top_comments(items: DataFrame, n: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """Non-root nodes with more than ``n`` descendants: ``(id, text, descendants)``, text unescaped."""
    counts = descendant_counts(items).where((F.col("depth") > 0) & (F.col("descendants") > n))
    counts = materialize(counts.select("id", "descendants"), "descendants")
    return with_text(counts, items, ("text",), texts).select("id", unescape_html(F.col("text")).alias("text"), "descendants")


def comment_depth(items: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Depth of every node of every thread and its text indented by one tab per level."""
    tree = assemble_threads(items, roots=items.where(F.col("type") == "story"), prune=False)
    rows = with_text(tree, items, cols=("text",), texts=texts)
    return rows.select("root_id", "id", "depth",
                       F.concat(F.repeat(F.lit("\t"), F.col("depth")), F.col("text")).alias("indented"))


def not_yet_processed(stories: DataFrame, done: DataFrame, done_col: str = "id") -> DataFrame:
    """Stories whose id is not yet in the output table."""
    keys = done.select(F.col(done_col).alias("_done"))
    return stories.join(keys, stories["id"] == keys["_done"], "left_anti")


def pick_listed(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Items whose id appears in a ranked list ``(id, position)``, in list order.

    A short list is broadcast by its measured size, a long one is not.
    """
    r = ranked.select(F.col("id").alias("_rid"), "position")
    return (items.join(r, items["id"] == r["_rid"], "inner")
                 .drop("_rid").orderBy("position"))


def thread_roots(items: DataFrame, *, prune: bool = True, live_mode: str = "falsy",
                 story_roots: bool = True, max_rounds: int | None = None) -> DataFrame:
    """C1 by pointer doubling: ``(root_id, id, parent, depth)`` in about log2(depth) joins.

    Every node starts pointing at its parent (a root at itself) and carries the
    distance to its pointer and whether any node from itself up to (excluding)
    its pointer is dead or deleted. Each round replaces the pointer by the
    pointer's pointer, adding distances and OR-ing the flags, until no pointer
    moves. A node whose pointer did not move points at its root and is settled: it is looked up
    by others but joined no more, so the rows that all point at one root never meet in a join.
    A node belongs to a pruned thread when nothing on its root path is dead or deleted. Use it for deep threads, where the level loop would need
    one round per level; it yields no ``path``. Nodes on a cycle never settle:
    after ``max_rounds`` (default ``ceil(log2 N) + 2``) it raises.
    """
    import math
    flag = ~(F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce(F.col("dead"), F.lit(False))) \
        if live_mode == "falsy" else (F.col("deleted").isNull() & F.col("dead").isNull())
    nodes = items.select("id", "parent", "type", (~flag).alias("_bad"))
    present = nodes.select(F.col("id").alias("_pid"))
    linked = nodes.join(present, nodes["parent"] == present["_pid"], "left")
    state = materialize(linked.select(
        "id", "parent", "type",
        F.coalesce(F.col("_pid"), F.col("id")).alias("ptr"),
        F.when(F.col("_pid").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("dist"),
        F.col("_bad").alias("bad")), "doubling")
    n = state.count()
    rounds = max_rounds or (int(math.ceil(math.log2(max(n, 2)))) + 2)
    settled = [state.where(F.col("dist") == 0)]
    state = state.where(F.col("dist") > 0)
    for _ in range(rounds):
        if state.isEmpty():
            break
        hop = reduce(lambda a, b: a.unionByName(b), [*settled, state]).select(
            F.col("id").alias("_hid"), F.col("ptr").alias("_hptr"), F.col("dist").alias("_hdist"), F.col("bad").alias("_hbad"))
        nxt = materialize(
            state.join(hop, state["ptr"] == hop["_hid"], "inner").select(
                "id", "parent", "type", F.col("_hptr").alias("ptr"),
                (F.col("dist") + F.col("_hdist")).alias("dist"),
                (F.col("bad") | F.col("_hbad")).alias("bad"),
                (F.col("_hptr") != F.col("ptr")).alias("_moved")), "doubling")
        # a node whose pointer reaches itself again with a distance travelled is on a cycle
        cyclic = nxt.agg(F.sum(((F.col("ptr") == F.col("id")) & (F.col("dist") > 0)).cast("int"))).first()[0]
        if cyclic:
            raise ThreadCycleError("parent pointers form a cycle")
        settled.append(nxt.where(~F.col("_moved")).drop("_moved"))
        state = nxt.where("_moved").drop("_moved")
    else:
        if not state.isEmpty():
            raise ThreadCycleError(f"pointers did not settle in {rounds} rounds (a cycle)")
    out = state = reduce(lambda a, b: a.unionByName(b), settled)
    if story_roots:
        root_type = state.select(F.col("id").alias("_rid"), F.col("type").alias("_rtype"))
        out = out.join(root_type, out["ptr"] == root_type["_rid"], "inner").where(F.col("_rtype") == "story")
    if prune:
        out = out.where(~F.col("bad"))
    return out.select(F.col("ptr").alias("root_id"), "id", "parent", F.col("dist").alias("depth"))
