"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows of the test items.

Texts are normalised to lower-case words with single blanks between them, and scanned once. Hits are
mapped back to word numbers and, for ``spans``, to character offsets of the original text.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import give_back, spare, stored

WINDOW = 10
#: Most characters of item texts in one automaton; a larger benchmark is scanned in several passes.
BLOCK_CHARS = 4_000_000
#: Columns that ``flag`` adds.
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
#: A word of a text that is not lower-cased yet.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Bytes of normalised text: a-z, 0-9 and every byte beyond ASCII stay, A-Z become small, others a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> str:
    """Words with a blank before and after each; one character per byte, so that texts scan as plain strings."""
    return f" {b' '.join(text.encode().translate(_NORMAL).split()).decode('latin-1')} "


def windows(text: str, size: int = WINDOW) -> list[str]:
    """Normalised windows of an item: ``size`` consecutive words, or all of them if there are fewer."""
    words = normal(text).split(" ")[1:-1]
    if words in ([], [""]):
        return []
    return [f" {' '.join(words[k:k + size])} " for k in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[object, str]], size: int = WINDOW):
    """One automaton of the items' windows, each with its number of words and its items' places in the list; None without windows."""
    import ahocorasick

    owners: dict[str, set[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in windows(text or "", size):
            owners.setdefault(w, set()).add(k)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, own in owners.items():
        found.add_word(w, (w.count(" ") - 1, tuple(own)))
    found.make_automaton()
    return found


def scan(machine, text: str) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, a mask of hit words and the places of the items that occur."""
    flat = normal(text)
    n = flat.count(" ") - 1 if len(flat) > 2 else 0
    hit, own, blanks = np.zeros(n, bool), set(), None
    if machine is None or n == 0:
        return n, hit, own
    for end, (words, items) in machine.iter(flat):
        if blanks is None:  # the number of blanks up to a place gives the word's number
            blanks = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(blanks, end))
        hit[last - words:last] = True
        own.update(items)
    return n, hit, own


def spans(machine, text: str) -> list[tuple[int, int]]:
    """Character ranges of the original text that hit windows cover, blanks between hit words included."""
    _, hit, _ = scan(machine, text)
    words = [m.span() for m in WORD.finditer(text)] if hit.any() else []
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(hit).tolist():
        if k and hit[k - 1]:
            out[-1] = (out[-1][0], words[k][1])
        else:
            out.append(words[k])
    return out


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> list[list[tuple[object, str]]]:
    """The items in blocks of about ``most`` characters each."""
    items = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // most)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    return [[(r.item_id, r.text) for r in items.where(part == k).collect()] for k in range(n)]


def flag(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_chars: int = BLOCK_CHARS, with_spans: bool = False) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated`` added (columns of these names are replaced).

    All rows and other columns stay; repeated rows are judged alike. Null and empty texts, and texts without words, have no hits; without
    items nothing has. ``items_sha256`` is over the item ids, each as text, sorted as strings and joined by
    commas (over an empty string if none occurs). ``with_spans`` adds ``spans``, the hit character ranges.
    Items beyond ``block_chars`` are scanned in several passes, so an automaton's size is bounded.
    """
    docs = docs.drop(*ADDED, *(["spans"] if with_spans else []))
    words, hits, found, at = spare(docs, "hit_words", "hit_ranges", "hit_items", "hit_spans")
    state = docs.withColumns({words: F.lit(0).cast("long"), hits: F.lit(None).cast("array<int>"),
                              found: F.lit(None).cast("array<string>")})
    blocks = _blocks(items, item_id, item_text, block_chars) or [[]]
    for k, block in enumerate(blocks):
        state = _pass(state if k == 0 else stored(state, "scan"), block, text, words, hits, found, window)
    ranges = F.coalesce(F.col(hits), F.array().cast("array<int>"))
    ids = F.array_sort(F.array_distinct(F.coalesce(F.col(found), F.array().cast("array<string>"))))
    more = [F.col(words).alias("n_words"), F.size(ranges).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size(ranges) > 0).alias("contaminated")]
    out = state.select(*docs.columns, *more, *([F.col(hits).alias(at)] if with_spans else []))
    return _with_spans(out, text, at) if with_spans else out


def _pass(state: DataFrame, block, text: str, words: str, hits: str, found: str, window: int) -> DataFrame:
    """Scan every text for one block of items, adding to the hits of earlier blocks."""
    spark = state.sparkSession
    held = spark.sparkContext.broadcast(block)
    names, schema = state.columns, state.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        machine = automaton(held.value, window)
        ids = [None if i is None else str(i) for i, _ in held.value]
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            n_words, all_hits, all_items = [], [], []
            for value, before, items in zip(columns[text], columns[hits], columns[found]):
                n, hit, own = scan(machine, value.as_py() or "")
                n_words.append(n)
                new = np.flatnonzero(hit)
                if len(new) and before.is_valid:
                    new = np.union1d(new, np.array(before.as_py(), int))
                all_hits.append(new.astype(np.int32) if len(new) else before.as_py())
                more = [ids[k] for k in own if ids[k] is not None]
                all_items.append((items.as_py() or []) + more if more else items.as_py())
            columns[words] = pa.array(n_words, pa.int64())
            columns[hits] = pa.array(all_hits, batch.schema.field(names.index(hits)).type)
            columns[found] = pa.array(all_items, batch.schema.field(names.index(found)).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return state.mapInArrow(run, schema)


def _with_spans(flagged: DataFrame, text: str, at: str) -> DataFrame:
    """Replace the numbers of hit words by character ranges of the original text."""

    def ranges(value: str | None, hit) -> list[dict]:
        words, out, last = [m.span() for m in WORD.finditer(value or "")], [], -2
        for k in hit if hit is not None else []:
            if k == last + 1:
                out[-1]["end"] = words[k][1]
            else:
                out.append({"start": words[k][0], "end": words[k][1]})
            last = k
        return out

    def run(values, hits):
        import pandas as pd

        return pd.Series([ranges(v, h) for v, h in zip(values, hits)])

    mapped = F.pandas_udf(run, "array<struct<start:int,end:int>>")
    return flagged.withColumn("spans", mapped(F.col(text), F.col(at))).drop(at)
