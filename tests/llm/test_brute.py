"""Second computations of what the quality and toxicity models return, one text and one word at a time."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from threadlens.llm import bytecnn, toxicity


def slow_logit(w, raw):
    """The network by its definition: every place of every chunk, one after the other."""
    raw = list(raw) + [0] * (-len(raw) % bytecnn.BLOCK if raw else bytecnn.BLOCK)
    groups = [raw[k:k + bytecnn.GROUP] for k in range(0, len(raw), bytecnn.GROUP)]
    vector = lambda g: np.concatenate([w["embed"][b] for b in g])
    value = []
    for k, g in enumerate(groups):
        after = groups[k + 1] if k + 1 < len(groups) else [0] * bytecnn.GROUP
        value.append(np.concatenate([vector(g), vector(after)]) @ w["filters"] + w["shift"])
    each = bytecnn.BLOCK // bytecnn.GROUP
    top = [np.max(value[k:k + each], axis=0) for k in range(0, len(value), each)]
    chunks = [np.maximum(np.maximum(a, b), 0) for a, b in zip(top, top[1:])] or [np.maximum(top[0], 0)]
    logits = [float(np.clip(np.tanh(c @ w["hidden"] + w["bias"]) @ w["out"], -30, 30)) for c in chunks]
    return math.log(sum(map(math.exp, logits)) / len(logits)) + float(w["last"][0])


def test_byte_network_equals_its_definition():
    w = bytecnn.start(3)
    rng = np.random.default_rng(5)
    texts = [b"", b"a", prose(40, 1).encode(), bytes(rng.integers(0, 256, 256).tolist()), prose(300, 2).encode(), "中文é".encode() * 200, b"\0" * 700]
    data, offsets = bytecnn.joined(texts)
    got = bytecnn.forward(w, data, offsets)
    assert np.allclose(got, [slow_logit(w, t) for t in texts], atol=1e-9)


def slow_margin(train, text):
    """Toxic minus ordinary log-likelihood per word from dictionaries of the training texts (label, text)."""
    def words_of(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return toxicity.tokens(raw, np.array([0, len(raw)]))[0].tolist()

    pair, alone, after = ([Counter(), Counter()] for _ in range(3))
    for c in (0, 1):
        triples = set()
        for label, t in train:
            if label == c:
                w = [0, 0, *words_of(t)]
                triples |= set(zip(w, w[1:], w[2:]))
        for _, b, x in triples:
            pair[c][b, x] += 1
        for b, x in pair[c]:
            alone[c][x] += 1
            after[c][b] += pair[c][b, x]

    def kept(counts, totals, c, key):
        n, other = counts[c][key], counts[1 - c][key]
        left = n - toxicity.DISCOUNT - toxicity.OTHER * (totals[c] / max(totals[1 - c], 1)) * (other + 1)
        return max(left, 0.0) if n > toxicity.RARE else 0.0

    singles, pairs = ([sum(a.values()) for a in side] for side in (alone, after))
    own = [{x: kept(alone, singles, c, x) for x in alone[c]} for c in (0, 1)]
    shared = defaultdict(lambda: 0.5)
    for c in (0, 1):
        for x in alone[c]:
            shared[x] += alone[c][x] - own[c][x]
    mass = sum(shared.values()) + 0.5 * ((1 << toxicity.WORD_BITS) - len(shared))
    follow = [Counter(), Counter()]
    for c in (0, 1):
        for b, x in pair[c]:
            follow[c][b] += kept(pair, pairs, c, (b, x)) / max(after[c][b], 1)
    total, count, before = 0.0, 0, 0
    for x in words_of(text):
        logs = []
        for c in (0, 1):
            single = own[c].get(x, 0.0) / singles[c] + (1 - sum(own[c].values()) / singles[c]) * shared.get(x, 0.5) / mass
            seen = kept(pair, pairs, c, (before, x)) / max(after[c][before], 1)
            logs.append(math.log(max(1 - follow[c][before], 1e-6) * single + seen))
        total, count, before = total + logs[1] - logs[0], count + 1, x
    return total / count if count else None


def test_toxic_margins_equal_dictionaries(spark):
    ugly = ["awful", "nasty", "vile", "rotten", "foul"]
    rows = []
    for k in range(60):
        w = prose(25, k).split()
        if k % 3 == 0:
            w = [x for j, y in enumerate(w) for x in ((y, ugly[(j + k) % 5]) if j % 3 == 0 else (y,))]
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    counted = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.CURVE_SHARE)) != 0).collect()}
    train = [(c, t) for i, t, c in rows if i in counted]
    asked = [(1, rows[3][1]), (2, rows[4][1]), (3, "awful new words, nasty and VILE stone"), (4, "!!"), (5, None)]
    got = {r.doc_id: r.toxic_margin for r in toxicity.compare(spark.createDataFrame(asked, "doc_id long, text string"), model, "text").collect()}
    for i, t in asked:
        want = slow_margin(train, t or "")
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-9
