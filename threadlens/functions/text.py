"""Tokenisers and string cleaners as native Column expressions.

Token profile (main tokenizer, F1): lower-case, take maximal runs of Unicode
letters/digits, drop runs that contain an ASCII digit, keep lengths 2..24, drop
stop words and the markup blacklist. Every function here compiles to JVM
expressions (``regexp_extract_all``, ``filter``, ``transform``); no Python runs per row.
Those with lambdas run without generated code, so counting plans explode
:func:`token_runs` instead.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.stopwords import BLACKLIST, PUNCTUATION, STOP_WORDS

WORD_RUN = r"[\p{L}\p{N}]+"
# A maximal letter/digit run with no ASCII digit, 2..24 characters long, as one
# regex pass (lookarounds pin it to whole runs); same tokens as WORD_RUN + filters.
TOKEN_RUN = r"(?<![\p{L}\p{N}])[\p{L}\p{N}&&[^0-9]]{%d,%d}(?![\p{L}\p{N}])"
WHITESPACE = "[\t\n\f\r ]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col




def token_runs(col, min_len: int = 2, max_len: int = 24) -> Column:
    """F1 before the stop-word test: one regex pass, no lambda (stays in generated code)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))),
                                F.lit(TOKEN_RUN % (min_len, max_len)), 0)


def is_kept(term_col, stop_words=STOP_WORDS, blacklist=BLACKLIST) -> Column:
    """Row-level stop-word test for exploded tokens (a hash-set ``InSet``)."""
    return ~_c(term_col).isin(sorted(set(stop_words) | set(blacklist)))


def tokens(col, *, stop_words=STOP_WORDS, blacklist=BLACKLIST, min_len: int = 2,
           max_len: int = 24) -> Column:
    """main tokenizer. Null text gives an empty array.

    Array form. Plans that explode tokens anyway should explode
    :func:`token_runs` and filter rows with :func:`is_kept`: Spark evaluates
    lambda functions without generated code, which slows the whole projection.
    """
    drop = sorted(set(stop_words) | set(blacklist))
    return F.filter(token_runs(col, min_len, max_len), lambda t: ~t.isin(drop))


def strip_punctuation(col) -> Column:
    """Remove ASCII punctuation characters (Python ``string.punctuation``)."""
    return F.translate(_c(col), PUNCTUATION, "")


def _split_ws(col) -> Column:
    return F.filter(F.split(col, WHITESPACE), lambda t: t != "")


def freq_words(col, *, legacy_order: bool = False) -> Column:
    """F4 before dropping empty strings and stop words (no lambda: stays in generated code
    except for the entity decoder)."""
    c = F.coalesce(_c(col), F.lit(""))
    if legacy_order:
        cleaned = unescape_html(strip_punctuation(F.lower(c)))
    else:
        cleaned = strip_punctuation(F.lower(unescape_html(c)))
    return F.split(cleaned, WHITESPACE)


def tokens_freq(col, *, legacy_order: bool = False, stop_words=STOP_WORDS) -> Column:
    """word-frequency tokenizer: lower, strip punctuation, unescape, split, drop stop words.

    By default entities are decoded before punctuation is stripped, so ``&quot;``
    never turns into the word ``quot``; ``legacy_order=True`` keeps the order
    lower → strip → unescape.
    """
    c = F.coalesce(_c(col), F.lit(""))
    if legacy_order:
        cleaned = unescape_html(strip_punctuation(F.lower(c)))
    else:
        cleaned = strip_punctuation(F.lower(unescape_html(c)))
    return F.filter(_split_ws(cleaned), lambda t: ~t.isin(list(stop_words)))


def tokens_plain(col) -> Column:
    """remove punctuation and split on white space; case is kept (stemming is separate)."""
    return _split_ws(strip_punctuation(F.coalesce(_c(col), F.lit(""))))


def tokens_alpha(col, *, stop_words=STOP_WORDS) -> Column:
    """remove punctuation and digits, split, drop case-sensitive stop words and 1-char tokens."""
    cleaned = F.regexp_replace(strip_punctuation(F.coalesce(_c(col), F.lit(""))), "[0-9]", "")
    return F.filter(_split_ws(cleaned), lambda t: (F.length(t) > 1) & ~t.isin(list(stop_words)))


def clean_line(col) -> Column:
    """newline, comma and carriage return become spaces."""
    return F.translate(_c(col), "\n,\r", "   ")


def ngrams(tokens_col, n: int) -> Column:
    """word n-grams of a token array (space-joined), in order; empty when too short.

    Built from ``n`` shifted slices zipped together, so the array is read a fixed
    number of times (linear in its length). Pass a column reference: an inline
    tokenizer expression would be evaluated once per slice.
    """
    t = _c(tokens_col)
    if n == 1:
        return t
    count = F.size(t) - (n - 1)
    grams = F.slice(t, 1, count)
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(t, k, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngrams_range(tokens_col, lo: int = 1, hi: int = 3) -> Column:
    """1..3-grams concatenated (unigrams first), as the n-gram vectorisers use them."""
    return F.concat(*[ngrams(tokens_col, n) for n in range(lo, hi + 1)])


def entity_table() -> dict[str, str]:
    """Named HTML entities (``&name;`` → character), built from the standard library table."""
    table = {name: chr(code) for name, code in html.entities.name2codepoint.items()}
    table["apos"] = "'"
    return table


def unescape_html(col) -> Column:
    """decode ``&name;``, ``&#NNN;`` and ``&#xHH;`` entities in one left-to-right pass.

    The text is split at ``&``; each later piece that starts with a known entity
    has it replaced, others get their ``&`` back. ``&amp;quot;`` therefore becomes
    ``&quot;`` (single pass), as with Python's ``html.unescape``.
    """
    table = entity_table()
    lookup = F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v))])
    c = _c(col)

    def piece(p, i):
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        dec = F.regexp_extract(p, r"^#([0-9]{1,7});", 1)
        hx = F.regexp_extract(p, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(dec != "", dec.cast("int")).when(hx != "", F.conv(hx, 16, 10).cast("int"))
        numeric = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.try_element_at(lookup, name)
        return (F.when(i == 0, p)
                .when((name != "") & named.isNotNull(),
                      F.concat(named, F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9]*;", "")))
                .when(code.isNotNull() & (code > 0) & (code <= 0x10FFFF),
                      F.concat(numeric, F.regexp_replace(p, r"^#[xX]?[0-9A-Fa-f]+;", "")))
                .otherwise(F.concat(F.lit("&"), p)))

    decoded = F.array_join(F.transform(F.split(c, "&"), piece), "")
    return F.when(F.instr(c, "&") > 0, decoded).otherwise(c)
