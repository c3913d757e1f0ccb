"""English suffix stemmer as a chain of anchored regex rewrites.

The rules are a compact step-1/step-2 suffix stripper (plural ``s``, ``ed``/``ing``
after a vowel, terminal ``y``, a few derivational endings). It is not claimed to
equal Snowball; it is a deterministic native expression, so it can run over the
distinct vocabulary and be repeated in SQL (``STEM_RULES`` is shared with the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (pattern, replacement) pairs applied in order; group references are written
# as {1} and rendered as $1 for Spark (Java) and \1 for RE2.
STEM_RULES = [
    ("sses$", "ss"),
    ("ies$", "i"),
    ("([^su])s$", "{1}"),
    ("eed$", "ee"),
    ("([aeiouy][a-z]*)(ed|ing)$", "{1}"),
    ("([a-z][aeiouy][a-z]*)y$", "{1}i"),
    ("ational$", "ate"),
    ("tional$", "tion"),
    ("ization$", "ize"),
    ("iveness$", "ive"),
    ("fulness$", "ful"),
    ("ousness$", "ous"),
    ("([a-z]{3})(ness|ment)$", "{1}"),
]


def _java(rep: str) -> str:
    return rep.replace("{1}", "$1")


def stem(col) -> Column:
    """Stem a single lower-case token column."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, rep in STEM_RULES:
        c = F.regexp_replace(c, pattern, _java(rep))
    return c


def stem_vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Stem each distinct term once: ``(term, stem)``. Join it back instead of stemming per token."""
    return terms.select(term_col).distinct().select(F.col(term_col).alias("term"),
                                                    stem(F.col(term_col)).alias("stem"))
