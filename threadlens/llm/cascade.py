"""Quality rules as a short-circuit cascade, in built-in DataFrame expressions only.

Every rule rejects a document or lets it pass, and a document is kept if no rule rejects it; so the
order of the rules changes the work, never the verdict. Each rule's cost and selectivity are measured on a
sample, rules are ordered by rejections per cost, and the ordered rules become the branches of one CASE
expression, which Spark evaluates only as far as the first rejection.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import SPACES, spare, stored

#: Rows of the sample on which rules are measured (about; drawn over the whole table).
SAMPLE_ROWS = 2_000
WINDOW = 8


class Rule(NamedTuple):
    """``reject`` is true for a document that goes; it may use ``text`` and the columns of ``signals``."""

    name: str
    reject: Column


class Measured(NamedTuple):
    name: str
    cost: float       # seconds over the sample
    rejected: int     # rows of the sample
    rows: int


def _step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a one-row generator, which later projections and filters are not merged into.

    Merged, a column that a lambda uses would be computed again for every element of the lambda's array.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def signals(docs: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of ``text`` (null: no words).

    Words are runs of characters other than ASCII white space. Columns of these names are replaced, all others stay.
    ``n_repeat_words`` counts words inside an 8-word window that occurs twice or more in the text; windows are compared by 64-bit hashes.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*own)
    kept = docs.columns
    words, hashed, runs, ranked, lines = spare(docs, "words", "hashed", "runs", "ranked", "lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, SPACES, " " * len(SPACES))
    listed = _step(_step(docs, words, F.array_remove(F.split(blank, " "), "")), lines,
                   F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    hashes = _step(listed, hashed, F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size(hashed)
    # hashes of the 8-word windows, in order
    windows = _step(hashes, runs, F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(hashed), i, WINDOW)))))
    # only texts with a repeated window sort (hash, position) pairs
    repeated = F.size(F.array_distinct(runs)) < F.size(runs)
    pairs = _step(windows, ranked, F.when(repeated, F.sort_array(
        F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(ranked)
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
        (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]
    return _step(pairs, "n_repeat_words", F.when(s.isNull(), 0).otherwise(covered).cast("long")).select(
        *kept, n.cast("long").alias("n_words"),
        F.length(F.replace(blank, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words")


def standard_rules() -> list[Rule]:
    """The rules of the query, on ``text`` and the signals; thresholds follow published web-text filters and are lenient."""
    n, text = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    lettered = F.size(F.regexp_extract_all(text, F.lit(r"[^ \t-\r]*\p{L}[^ \t-\r]*"), F.lit(0)))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    starts = F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))
    ends = F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > 3 * F.size(lines)),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("few_lettered_words", lettered * 10 < 7 * n),
        Rule("few_distinct_words", F.size(F.array_distinct(words)) * 10 < n),
        Rule("bullet_lines", F.size(starts) * 10 > 9 * F.size(lines)),
        Rule("cut_lines", F.size(ends) * 10 > 3 * F.size(lines)),
    ]


def measure(docs: DataFrame, rules: list[Rule], first: Column, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and rejections of each rule over a random sample of ``docs`` (``text``) that passes ``first``.

    The sample is drawn over the whole table and stored with its signals, so a rule's time is its own. Null
    verdicts count as not rejected. An empty table gives costs over no rows.
    """
    text = docs.select("text")
    part = text.sample(min(1.0, sample_rows / max(text.count(), 1)), seed=7)
    sample = stored(signals(part), "sample").where(~F.coalesce(first, F.lit(False)))
    rows = sample.count()
    found = []
    for rule in rules:
        times = []
        for _ in range(2):  # the first run also compiles the rule
            began = time.perf_counter()
            hits = sample.agg(F.count_if(F.coalesce(rule.reject, F.lit(False)))).first()[0]
            times.append(time.perf_counter() - began)
        found.append(Measured(rule.name, min(times), hits, rows))
    return found


def ordered(rules: list[Rule], measured: list[Measured]) -> list[Rule]:
    """Rules by rejections per cost, the most first; ties keep their given order."""
    worth = {m.name: m.rejected / max(m.cost, 1e-9) for m in measured}
    return sorted(rules, key=lambda r: -worth[r.name])


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects; later rules are not evaluated for a document that an earlier one rejects."""
    if not rules:
        return F.lit(True)
    case = F.when(rules[0].reject, False)
    for rule in rules[1:]:
        case = case.when(rule.reject, False)
    return case.otherwise(True)


def cascade(docs: DataFrame, rules: list[Rule] | None = None, first: Column | None = None,
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the signals, ``base_failed`` and ``kept`` added (columns of these names are replaced).

    ``first`` is a test that always stands before the cascade (by default: under 20 words, or over 30 % of
    the words in repeated windows). Null and empty texts have no words and fail it. Repeated rows are judged alike.
    """
    rules = standard_rules() if rules is None else rules
    if first is None:
        first = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = signals(docs.drop("base_failed", "kept"))
    order = ordered(rules, measure(docs, rules, first, sample_rows))
    return judged.withColumn("base_failed", F.coalesce(first, F.lit(False))) \
                 .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(order)))


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents`` (the verdict does not depend on the rules' order)."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS lines FROM d),
r AS (SELECT *, CASE WHEN len(words) >= {WINDOW} THEN list_transform(range(1, len(words) - {WINDOW - 2}),
      lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' ')) ELSE [] END AS runs FROM w),
e AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS pos FROM r),
p AS (SELECT DISTINCT doc_id, pos + k.k AS pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM e) e,
      (SELECT unnest(range({WINDOW})) AS k) k WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
s AS (SELECT r.doc_id, t, words, lines, len(words) AS n_words,
      length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM r LEFT JOIN c ON r.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > 3 * len(lines)
  OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) * 10 < 7 * n_words
  OR len(list_distinct(words)) * 10 < n_words
  OR len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) * 10 > 9 * len(lines)
  OR len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) * 10 > 3 * len(lines)) AS kept
FROM b"""
