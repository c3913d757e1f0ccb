"""Hand-made trees (FIXTURES.md part 3)."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import threads as C


def story(i, **kw):
    return {"id": i, "type": "story", "title": f"title {i}", **kw}


def comment(i, parent, text="x", **kw):
    return {"id": i, "type": "comment", "parent": parent, "text": text, **kw}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sample_story_depth_and_descendants(make_items):
    its = make_items([story(1, text="story text"), comment(2, 1, "hello")])
    tree = C.assemble_threads(its)
    assert rows(tree, "id", "depth") == [(1, 0), (2, 1)]
    assert rows(C.descendant_counts(its), "id", "descendants") == [(1, 1), (2, 0)]


def test_dead_inner_node_prunes_subtree_but_not_comment_corpus(make_items):
    its = make_items([story(1), comment(2, 1, "dead one", dead=True), comment(3, 2, "reply")])
    assert rows(C.assemble_threads(its), "id") == [(1,)]
    corpus = C.comment_corpus(its)
    assert rows(corpus, "id") == [(3,)]  # dead text hidden, reply kept


def test_deleted_root_has_no_thread(make_items):
    its = make_items([story(1, deleted=True), comment(2, 1)])
    assert C.assemble_threads(its).count() == 0


def test_orphan_is_promoted_by_link_forest_and_unreachable_in_threads(make_items):
    its = make_items([story(1), comment(2, 1), comment(5, 99, "orphan")])
    forest = C.link_forest(its)
    assert rows(forest, "id", "is_root") == [(1, True), (2, False), (5, True)]
    assert rows(C.assemble_threads(its), "id") == [(1,), (2,)]


def test_text_less_comment_keeps_siblings_and_replies(make_items):
    its = make_items([story(1), comment(2, 1, None), comment(3, 1, "b"), comment(4, 1, "c"), comment(5, 2, "r")])
    assert rows(C.thread_text(its, "once"), "id") == [(3,), (4,), (5,)]


def test_multi_kid_weight(make_items):
    its = make_items([story(1), comment(2, 1, "inner"), comment(3, 2, "a"), comment(4, 2, "b"), comment(5, 2, "c")])
    once = {r["id"]: r["copies"] for r in C.thread_text(its, "once").collect()}
    legacy = {r["id"]: r["copies"] for r in C.thread_text(its, "legacy").collect()}
    assert once[2] == 1 and legacy[2] == 3 and legacy[3] == 1


def test_deep_chain_beyond_recursive_cte_default(make_items):
    n = 150
    its = make_items([story(0)] + [comment(i, i - 1) for i in range(1, n)])
    tree = C.assemble_threads(its)
    assert tree.agg(F.max("depth")).first()[0] == n - 1
    counts = dict(rows(C.descendant_counts(its), "id", "descendants"))
    assert counts[0] == n - 1 and counts[n - 1] == 0
    assert sum(counts.values()) == n * (n - 1) // 2


def test_cycle_below_root_raises(make_items):
    # id 2 appears twice: once under the story, once under its own child -> a cycle on the path
    its = make_items([story(1), comment(2, 1), comment(3, 2), comment(2, 3)])
    with pytest.raises(C.ThreadCycleError):
        C.assemble_threads(its)


def test_max_depth_guard(make_items):
    its = make_items([story(0)] + [comment(i, i - 1) for i in range(1, 6)])
    with pytest.raises(RuntimeError):
        C.assemble_threads(its, max_depth=3)


def test_leaf_corpus_uses_leaves_only(make_items):
    its = make_items([story(1), comment(2, 1, "inner"), comment(3, 2, "leaf a"),
                      comment(4, 1, "leaf dead", dead=True), comment(5, 2, "leaf b")])
    parts = rows(C.leaf_corpus(its), "part", "id")
    assert parts == [("leaf", 3), ("leaf", 5), ("title", 1)]


def test_empty_input_keeps_schema(make_items):
    its = make_items([])
    tree = C.assemble_threads(its)
    assert tree.count() == 0 and tree.columns == C.TREE_COLS


def test_pointer_doubling_equals_level_loop(make_items):
    its = make_items([story(1), comment(2, 1), comment(3, 2, dead=True), comment(4, 3), comment(5, 1),
                      story(10, deleted=True), comment(11, 10), comment(20, 99)])
    a = rows(C.assemble_threads(its), "root_id", "id", "depth")
    b = rows(C.thread_roots(its), "root_id", "id", "depth")
    assert a == b == [(1, 1, 0), (1, 2, 1), (1, 5, 1)]


def test_pointer_doubling_deep_chain_and_cycle(make_items):
    n = 150
    its = make_items([story(0)] + [comment(i, i - 1) for i in range(1, n)])
    assert C.thread_roots(its).agg(F.max("depth")).first()[0] == n - 1
    cyc = make_items([story(1), comment(2, 3), comment(3, 2)])
    with pytest.raises(C.ThreadCycleError):
        C.thread_roots(cyc)
