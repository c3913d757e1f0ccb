"""Decontamination, rule cascade, line frequency and near duplicates against brute force."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF, prose
from tests.oracle_compare import compare, duck
from threadlens.llm import cascade, decontam, graph, linefreq, probminhash, queries

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute_flags(text, items, size=10):
    words = WORD.findall((text or "").translate(LOW))
    hit, own = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOW))
        for win in [w[k:k + size] for k in range(max(1, len(w) - size + 1))] if w else []:
            for k in range(len(words) - len(win) + 1):
                if words[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    own.add(str(item))
    return len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


@settings(max_examples=200, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "B", "c-", "é", ".", "\n"]), max_size=30).map(" ".join),
       items=st.lists(st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=6).map(" ".join), max_size=3))
def test_scan_equals_brute_force(text, items):
    rows = list(enumerate(items))
    machine = decontam.automaton(rows, 3)
    n, hit, own = decontam.scan(machine, text)
    assert (n, int(hit.sum()), len(own)) == brute_flags(text, rows, 3)[:3]


@pytest.mark.parametrize("block", [4_000_000, 200])
def test_flag(spark, clashing, odd_rows, block):
    items = [(10, prose(60, 1)[:150]), (9, "SHORT"), (None, "seven"), (11, None), (12, "!!"), (2, prose(30, 4))]
    out = decontam.flag(clashing, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=block).collect()
    named = [(i, t) for i, t in items if i is not None]
    for r in out:
        n, _, k, sha, _ = brute_flags(r.text, named)
        assert (r.n_words, r.n_items, r.items_sha256) == (n, k, sha)
        assert (r.n_hit, r.contaminated) == tuple(brute_flags(r.text, items)[j] for j in (1, 4))
    assert len(out) == len(odd_rows)


def test_flag_spans_and_empty(spark, empty, odd):
    items = spark.createDataFrame([(1, "Stone river lamp")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "A stone,  RIVER lamp; stone river lamp. End")], "doc_id bigint, text string")
    row = decontam.flag(docs, items, with_spans=True).first()
    assert [row.text[s.start:s.end] for s in row.spans] == ["stone,  RIVER lamp; stone river lamp"]
    assert decontam.flag(empty, items).count() == 0
    assert decontam.flag(odd, items.limit(0)).where("contaminated").count() == 0


def brute_signals(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    inside = {k + j for k, w in enumerate(runs) if runs.count(w) > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_signals(spark):
    texts = [None, "", " \n", "a b", "a b c d e f g h " * 3, "a a a a a a a a a a", prose(200, 3), "x | y\nx | y\n\nx | y é😀#",
             prose(12, 5) + "\n" + prose(12, 5), prose(30, 2) + " " + prose(9, 2) + "\x0b\x0cz"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, words string")
    for r in cascade.signals(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_signals(r.text), r.text
    assert r.words == "x"


def test_cascade_order_does_not_change_the_verdict(clashing, empty, odd_rows):
    rules = cascade.standard_rules()
    out = cascade.cascade(clashing, rules, sample_rows=5)
    assert out.count() == len(odd_rows)
    state = cascade.signals(clashing)
    for order in (rules, rules[::-1]):
        same = state.select("doc_id", cascade.verdict(order).alias("v")).where("v").select("doc_id").collect()
        first = state.select("doc_id", cascade.verdict(rules).alias("v")).where("v").select("doc_id").collect()
        assert sorted(map(str, same)) == sorted(map(str, first))
    assert cascade.cascade(empty).count() == 0


def test_cascade_orders_by_rejections_per_cost():
    rules = [cascade.Rule(n, F.lit(True)) for n in "abc"]
    seen = [cascade.Measured("a", 2.0, 4, 9), cascade.Measured("b", 1.0, 9, 9), cascade.Measured("c", 0.1, 1, 9)]
    assert [r.name for r in cascade.ordered(rules, seen)] == ["c", "b", "a"]


def test_cascade_plan_has_no_python(odd):
    plan = cascade.cascade(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_frequency(spark, clashing, empty, odd_rows):
    rows = [(k, f"Menu\nline {k}\n\n  Menu \nend", "h") for k in range(20)] + [(99, "Menu\nx", None), (98, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = {r.doc_id: r for r in linefreq.drop_lines(docs, ratio=0.5).collect()}
    assert out[3].text == "line 3\n" and (out[3].n_lines, out[3].n_dropped) == (5, 3)
    assert out[99].text == "Menu\nx" and out[98].text is None and out[98].n_lines == 0
    assert linefreq.drop_lines(empty).count() == 0
    assert linefreq.drop_lines(clashing).count() == len(odd_rows)


@pytest.mark.parametrize("name", ["op7_rule_cascade", "op10_site_line_frequency"])
def test_oracles(spark, name):
    ok, message = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert ok, message


def sets(texts, size=5):
    out = {}
    for k, t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out[k] = {tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_classes(texts, similarity=0.8):
    found, parent = sets(texts), {k: k for k, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and found[a] and len(found[a] & found[b]) >= similarity * len(found[a] | found[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def edited(base, k):
    words = base.split()
    words[(7 * k) % len(words)] = f"new{k}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(120, s) for s in range(3)]
    texts = [(k, edited(base[k % 3], k)) for k in range(36)] + [(50 + k, prose(80, 100 + k)) for k in range(20)]
    # a star: the middle is near each arm, the arms are not near each other
    arms = prose(100, 77).split()
    texts += [(200, " ".join(arms))] + [(201 + k, " ".join(arms[:10 * k] + [f"q{k}a", f"q{k}b"] + arms[10 * k + 2:])) for k in range(1, 9)]
    texts += [(300, None), (301, ""), (302, "!"), (303, "one two"), (304, "One, two"), (305, texts[0][1].upper())]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_with_other_repeat_counts(spark):
    """Near by distinct shingles, far by weighted ones: a line occurs once in one text and many times in the other."""
    texts = []
    for k in range(12):
        body, line = " ".join(f"w{k}x{j}" for j in range(200)), " ".join(f"m{k}x{j}" for j in range(20))
        texts += [(2 * k, f"{body}\n{line}"), (2 * k + 1, f"{body}\n" + f"{line}\n" * (10 + 4 * k))]
    want = brute_classes(texts)
    assert want == {j: j - j % 2 for j in range(24)}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()} == want


def test_borderline_copies_equal_brute_force(spark, monkeypatch):
    """Copies with few and many edits, near the base, near each other only, or near none: few hubs are tried, the rest is searched."""
    monkeypatch.setattr(probminhash, "HUB_ROUNDS", 1)
    base = [f"b{j}" for j in range(200)]

    def copy(k, edits, also=()):
        w = list(base)
        for j in range(edits):
            w[(13 * k + 17 * j) % 200] = f"e{k}x{j}"
        for j in also:
            w[j] = f"shared{j}"
        return " ".join(w)

    texts = [(k, copy(k, k % 12)) for k in range(60)] + [(100 + k, copy(100 + k, k % 3, range(5, 200, 9))) for k in range(8)]
    texts += [(200 + k, copy(200 + k, 30)) for k in range(6)] + [(300 + k, copy(300, 14) + f" tail{k}") for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = brute_classes(texts)
    assert len(set(want.values())) > 5
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()} == want
    kept = probminhash.keep_one(docs.unionByName(docs.limit(3))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_filter_holds_every_key(spark):
    from threadlens.llm.common import maybe_in

    few = spark.range(0, 3000, 3).unionByName(spark.createDataFrame([(None,)], "id long"))
    hit = {r.id for r in spark.range(100_000).where(maybe_in(few, "id", F.col("id"))).collect()}
    assert set(range(0, 3000, 3)) <= hit and len(hit) < 1020
    assert spark.range(1000).where(maybe_in(few.limit(0), "id", F.col("id"))).count() == 0


def test_near_duplicates_of_odd_rows(spark, clashing, empty, odd_rows):
    out = probminhash.near_duplicates(clashing).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r.class_id for r in out}
    assert by[6] == by[1] == 1 and by[2] == 2 and by[3] == 3
    kept = probminhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 6 not in ids and set(ids) == {None, 1, 2, 3, 4, 5, 7, 8, 9}
    assert probminhash.near_duplicates(empty).count() == 0 and probminhash.keep_one(empty).count() == 0


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    items = rng.integers(1, 2 ** 44, 300).astype(np.uint64)
    a, b = {k: rng.integers(1, 6) for k in range(200)}, {}
    b = {k: a[k] * (1 if k % 3 else 2) for k in range(60, 200)} | {k: 3 for k in range(200, 260)}
    rows = np.array([0] * len(a) + [1] * len(b))
    keys, weights = [*a, *b], np.array([*a.values(), *b.values()])
    sig = probminhash.signatures(rows, items[keys], weights, 2, 4000)
    want = sum(1 / sum(max(a.get(j, 0) / a[k], b.get(j, 0) / b[k]) for j in {*a, *b}) for k in a.keys() & b.keys())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 120), (120, 110), (7, 7), (300, 301)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 110: 100, 120: 100, 300: 300, 301: 300}
