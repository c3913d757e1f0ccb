"""Token tables, frequencies, document frequency, vocabulary, bag of words.

Token data stays in long form ``(id, term)`` / ``(id, term, tf)``: exploding and
aggregating at once keeps the widest stage short, and no document's tokens are
ever gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.snowball import snowball_stems
from threadlens.functions.stopwords import STOP_WORDS
from threadlens.functions.text import freq_words, is_kept, token_runs, tokens_freq
from threadlens.functions.text import tokens as default_tokens
from threadlens.operators.ranking import top_k_per_group
from threadlens.session import materialize, text_tasks

#: Texts of a group that are counted in one task, at most.
MOST_TOGETHER = 20_000


def explode_tokens(df: DataFrame, keys: Sequence[str], text_col: str = "text",
                   tokenizer: Callable[[Column], Column] = default_tokens,
                   with_position: bool = False) -> DataFrame:
    """Long-form tokens: ``(*keys, term)`` (``pos`` too when asked).

    For the main tokenizer the raw regex matches are exploded and stop words
    are dropped as rows, which keeps the stage in whole-stage code generation.
    """
    if tokenizer is default_tokens and not with_position:
        return df.select(*keys, F.explode(token_runs(F.col(text_col))).alias("term")) \
                 .where(is_kept(F.col("term")))
    if tokenizer is tokens_freq and not with_position:
        return df.select(*keys, F.explode(freq_words(F.col(text_col))).alias("term")) \
                 .where((F.col("term") != "") & ~F.col("term").isin(list(STOP_WORDS)))
    toks = tokenizer(F.col(text_col))
    if with_position:
        return df.select(*keys, F.posexplode(toks).alias("pos", "term"))
    return df.select(*keys, F.explode(toks).alias("term"))


def term_frequencies(df: DataFrame, keys: Sequence[str], text_col: str = "text",
                     tokenizer: Callable[[Column], Column] = default_tokens,
                     weight_col: str | None = None) -> DataFrame:
    """``(*keys, term, tf)``; ``weight_col`` multiplies each row's tokens (repeated texts)."""
    cols = list(keys) + ([weight_col] if weight_col else [])
    toks = explode_tokens(df, cols, text_col, tokenizer)
    tf = F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))
    return toks.groupBy(*keys, "term").agg(tf.cast("bigint").alias("tf"))


def word_freq(df: DataFrame, keys: Sequence[str], text_col: str = "text",
              tokenizer: Callable[[Column], Column] = default_tokens, together: bool = False) -> DataFrame:
    """``(*keys, word, freq)`` word counts per key; ``together``: see :func:`term_frequencies_together` (one key)."""
    tf = term_frequencies_together(df, *keys, text_col, tokenizer) if together else term_frequencies(df, keys, text_col, tokenizer)
    return tf.select(*keys, F.col("term").alias("word"), F.col("tf").alias("freq"))


def term_frequencies_together(df: DataFrame, key: str, text_col: str = "text",
                              tokenizer: Callable[[Column], Column] = default_tokens, carry: Sequence[str] = ()) -> DataFrame:
    """:func:`term_frequencies` of groups of texts (threads): ``(key, *carry, term, tf)``, partitioned by ``key``.

    A group's texts meet in one task before they are tokenized, so that its words are counted there and not shuffled text by text.
    Only groups of at most :data:`MOST_TOGETHER` texts do; the texts of larger ones stay spread and their words are combined.
    ``carry`` names columns that are the same in all rows of a key.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keys = [key, *carry]
    together, *spread = (term_frequencies(part, keys, text_col, tokenizer) for part in dealt(df.select(*keys, text_col), key, sizes))
    return together.unionByName(spread[0]) if spread else together


def dealt(df: DataFrame, key: str, sizes: DataFrame) -> list[DataFrame]:
    """``df`` with each group's rows in one task, for groups (``sizes``: key, _n) of at most :data:`MOST_TOGETHER`; then, if there
    are any, the rows of larger groups, as they are spread."""
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    parts = []
    if (largest or 0) > MOST_TOGETHER:
        large = materialize(sizes.where(F.col("_n") > MOST_TOGETHER).select(key), "large_groups")
        parts = [df.join(large, key, "left_semi")]
        df = df.join(large, key, "left_anti")
    return [df.repartition(text_tasks(df, total or 0), key), *parts]


def stemmed_tokens(df: DataFrame, keys: Sequence[str], text_col: str = "text",
                   tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """F2 + F9: ``(*keys, pos, stem)``. Each distinct term is stemmed once and joined back to its occurrences."""
    toks = materialize(explode_tokens(df, keys, text_col, tokenizer, with_position=True), "tokens")
    stems = snowball_stems(toks)
    return toks.join(stems, "term").select(*keys, "pos", "stem")


def stemmed_grams(df: DataFrame, keys: Sequence[str], text_col: str = "text", hi: int = 3,
                  tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """F2 + F9 + F7: ``(*keys, term, tf)`` of the 1- to ``hi``-grams of stems, within each text (``keys`` name one text).

    Neighbours are found by a window in text order, so no text's grams are gathered into one row.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    toks = stemmed_tokens(df, keys, text_col, tokenizer)
    after = [F.lead("stem", k).over(order).alias(f"_{k}") for k in range(1, hi)]
    toks = toks.select(*keys, F.col("stem").alias("_0"), *after)
    grams = [F.when(F.col(f"_{n - 1}").isNotNull(), F.concat_ws(" ", *[f"_{k}" for k in range(n)])) for n in range(1, hi + 1)]
    flat = toks.select(*keys, F.explode(F.array(*grams)).alias("term")).where("term IS NOT NULL")
    return flat.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_stemmed_grams(df: DataFrame, key: str, n: int, text_col: str = "text", hi: int = 3,
                      tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    """The ``n`` commonest of :func:`stemmed_grams`: ``(term, df, cf)`` by falling ``cf`` (ties by term), over texts named by ``key``.

    A gram is no commoner than any of its stems, and single stems are grams too: one that holds a stem rarer than the n-th commonest
    stem is not among the first n. So stems are counted first, and only grams of the (about n) stems that are left are made and
    counted. Every text is read whole both times and the result is that of counting all grams.
    """
    words = materialize(explode_tokens(df, [], text_col, tokenizer).groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "words")
    stems = materialize(words.join(snowball_stems(words), "term").select("term", "stem", "cf"), "word_stems")
    sums = stems.groupBy("stem").agg(F.sum("cf").alias("cf"))
    found, least = sums.orderBy(F.col("cf").desc()).limit(n).agg(F.count(F.lit(1)), F.min("cf")).first()
    often = sums.where(F.col("cf") >= (least if found == n else 0)).select("stem")
    often = materialize(stems.join(often, "stem").select("term", "stem"), "often")
    texts = df.select(key, text_col)
    toks = texts.repartition(text_tasks(texts, texts.count()), key).select(key, tokenizer(F.col(text_col)).alias("_t"))
    after = [F.slice("_t", k + 1, F.greatest(F.size("_t"), F.lit(0))).alias(f"_w{k}") for k in range(1, hi)]
    rows = toks.select(key, F.col("_t").alias("_w0"), *after)
    rows = rows.select(key, F.inline(F.arrays_zip(*[f"_w{k}" for k in range(hi)])))
    for k in range(hi):
        side = often.select(F.col("term").alias(f"_w{k}"), F.col("stem").alias(f"_{k}"))
        rows = rows.join(side, f"_w{k}", "left" if k else "inner").drop(f"_w{k}")
    grams, whole = [], F.lit(True)
    for m in range(hi):
        whole = whole & F.col(f"_{m}").isNotNull()      # no stem of the gram is a rare one
        grams.append(F.when(whole, F.concat_ws(" ", *[f"_{k}" for k in range(m + 1)])))
    flat = rows.select(key, F.explode(F.array(*grams)).alias("term")).where("term IS NOT NULL")
    counted = doc_freq(flat.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    return counted.select("term", "df", "cf").orderBy(F.col("cf").desc(), F.col("term")).limit(n)


def top_grams(df: DataFrame, n: int, text_col: str = "text", hi: int = 3,
              tokenizer: Callable[[Column], Column] = default_tokens, first: int = 2_000) -> DataFrame:
    """the ``n`` commonest 1- to ``hi``-grams of the texts, of each length: ``(n, gram, cnt, rank)`` (ties by gram).

    A gram is no commoner than any of its words. Grams of the ``first`` commonest words are counted, and their n-th count is a bound: if
    it is not below the rarest of these words, a gram with any other word is not among the first n; else the grams of all words that
    reach the bound are counted. Every text is read whole each time and the result is that of counting all grams.
    """
    words = materialize(explode_tokens(df, [], text_col, tokenizer).groupBy("term").agg(F.count(F.lit(1)).alias("cf")), "words")
    found, least = words.orderBy(F.col("cf").desc()).limit(first).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = least if found == first else 0
    while True:
        often = materialize(words.where(F.col("cf") >= least), "often")
        counts = _grams_of(df, often.select("term"), text_col, hi, tokenizer).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("cnt"))
        counts = often.select(F.lit(1).alias("n"), F.col("term").alias("gram"), F.col("cf").alias("cnt")).unionByName(counts)
        top = materialize(top_k_per_group(counts, ["n"], [F.col("cnt").desc(), F.col("gram")], n).select("n", "gram", "cnt", "rank"), "top_grams")
        reached = [r["least"] for r in top.groupBy("n").agg(F.count(F.lit(1)).alias("found"), F.min("cnt").alias("least")).collect() if r["found"] == n]
        bound = min(reached) if len(reached) == hi else 0
        if bound >= least or least <= 1:
            return top
        least = bound


def _grams_of(df: DataFrame, words: DataFrame, text_col: str, hi: int, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """``(n, gram)`` for each 2- to ``hi``-gram of the texts that has only ``words`` (distinct)."""
    after = [F.slice("_t", k + 1, F.size("_t")).alias(f"_w{k}") for k in range(1, hi)]
    rows = df.select(tokenizer(F.col(text_col)).alias("_t")).where(F.size("_t") > 0).select(F.col("_t").alias("_w0"), *after)
    rows = rows.select(F.inline(F.arrays_zip(*[f"_w{k}" for k in range(hi)])))
    for k in range(hi):
        side = words.select(F.col("term").alias(f"_w{k}"), F.lit(True).alias(f"_{k}"))
        rows = rows.join(side, f"_w{k}", "left" if k > 1 else "inner")
    grams = [F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "_w0", "_w1").alias("gram"))]
    whole = F.lit(True)
    for m in range(3, hi + 1):
        whole = whole & F.col(f"_{m - 1}").isNotNull()
        grams.append(F.when(whole, F.struct(F.lit(m).alias("n"), F.concat_ws(" ", *[f"_w{k}" for k in range(m)]).alias("gram"))))
    return rows.select(F.explode(F.array(*grams)).alias("_g")).where("_g IS NOT NULL").select("_g.n", "_g.gram")


@dataclass
class CommonGrams:
    """``counts``: (key, term, tf) of the grams that can be in enough groups; ``n``: the groups with a token; ``words``: (term, name),
    every word and the name (stem, or the word) that stands for it in grams."""

    counts: DataFrame
    n: int
    words: DataFrame


def common_grams(df: DataFrame, key: str, share: float, text_col: str = "text", hi: int = 3,
                 tokenizer: Callable[[Column], Column] = default_tokens, stemmed: bool = False) -> CommonGrams:
    """F7 for a cut by document frequency: the 1- to ``hi``-grams of the texts, counted by ``key`` (several texts share one; a gram
    lies in one text), without grams that fewer than ``share`` of the groups can have.

    A gram is in no more groups than any part of it, and a part in no more groups than it has occurrences. So words are counted
    first, then longer and longer grams whose parts are left, over the whole corpus; the tables of what is left have at most (grams
    of a group, on average) / ``share`` rows, however many groups there are. Only their grams are counted by group, where a
    group's texts meet. Counts are exact; some grams below the share stay and are left to the caller's cut.
    """
    texts = df.select(F.col(key).alias("_k"), tokenizer(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    none = texts.schema["_k"].dataType
    found = F.concat(F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.lit(None).cast(none).alias("_k"))),
                     F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("_k").alias("_k"))))
    seen = texts.select(F.explode(found).alias("_e")).select("_e.term", "_e._k")
    seen = materialize(seen.groupBy("term", "_k").agg(F.count(F.lit(1)).alias("_n")), "words")     # a row a word, and one a group
    sizes = seen.where("_k IS NOT NULL").select(F.col("_k").alias(key), "_n")
    n = sizes.count()
    least = share * n
    words = seen.where("term IS NOT NULL").select("term", "_n")
    names = words.select("term", F.col("term").alias("name"), "_n")
    if stemmed:
        names = materialize(words.join(snowball_stems(words), "term").select("term", F.col("stem").alias("name"), "_n"), "names")
    enough = names.groupBy("name").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least)
    often = materialize(names.join(enough, "name", "left_semi").select("term", "name"), "often")
    kept: list[DataFrame] = []      # of 2, 3, ... hi - 1 names
    for m in range(2, hi):
        rows, grams = _gram_columns(texts, often, kept, m)
        rows = rows.select(grams[-1].alias("gram")).where("gram IS NOT NULL")
        kept.append(materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("gram"), "kept"))
    counted = []
    for part in dealt(df.select(key, text_col), key, sizes):
        rows, grams = _gram_columns(part.select(key, tokenizer(F.col(text_col)).alias("_t")).where(F.size("_t") > 0), often, kept, hi, key)
        flat = rows.select(key, F.explode(F.array(*grams)).alias("term")).where("term IS NOT NULL")
        counted.append(flat.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    return CommonGrams(reduce(lambda a, b: a.unionByName(b), counted), n, names.select("term", "name"))


def _gram_columns(texts: DataFrame, often: DataFrame, kept: Sequence[DataFrame], hi: int, *keys: str) -> tuple[DataFrame, list[Column]]:
    """A row (with ``keys``) for each word of the token arrays ``_t`` that ``often`` (term, name) has, and the 1- to ``hi``-grams that
    start there: null where a name or a shorter gram inside is not in ``often`` or ``kept`` (tables of 2, 3, ... names)."""
    after = [F.slice("_t", k + 1, F.size("_t")).alias(f"_w{k}") for k in range(1, hi)]
    rows = texts.select(*keys, F.col("_t").alias("_w0"), *after)
    rows = rows.select(*keys, F.inline(F.arrays_zip(*[f"_w{k}" for k in range(hi)])))
    for k in range(hi):
        side = F.broadcast(often.select(F.col("term").alias(f"_w{k}"), F.col("name").alias(f"_1_{k}")))
        rows = rows.join(side, f"_w{k}", "left" if k else "inner").drop(f"_w{k}")

    def gram(m, k):     # of the m names from place k on, if both shorter grams in it are there
        return F.when(F.col(f"_{m - 1}_{k}").isNotNull() & F.col(f"_{m - 1}_{k + 1}").isNotNull(),
                      F.concat_ws(" ", *[f"_1_{j}" for j in range(k, k + m)]))

    for m, table in enumerate(kept[:hi - 1], 2):
        for k in range(hi - m + 1):
            name = f"_{m}_{k}"
            side = F.broadcast(table.select(F.col("gram").alias(f"{name}_g"), F.col("gram").alias(name)))
            rows = rows.withColumn(f"{name}_g", gram(m, k)).join(side, f"{name}_g", "left").drop(f"{name}_g")
    ready = [F.col("_1_0"), *[F.col(f"_{m}_0") for m in range(2, len(kept[:hi - 1]) + 2)]]
    return rows, ready + [gram(m, 0) for m in range(len(ready) + 1, hi + 1)]


def term_count(tokens_col: str, term: str) -> Column:
    """Occurrences of ``term`` in a token array."""
    return F.size(F.filter(F.col(tokens_col), lambda t: t == F.lit(term)))


def doc_freq(doc_terms: DataFrame, id_col: str = "id") -> DataFrame:
    """``(term, df, cf)`` from ``(id, term, tf)``; partial aggregation combines hot terms map-side."""
    return doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                         F.sum("tf").cast("bigint").alias("cf"))


def n_documents(docs: DataFrame) -> Column:
    """Number of input documents as a scalar subquery (a cheap count, no tokenizing)."""
    return docs.select(F.count(F.lit(1))).scalar()


def idf(doc_terms: DataFrame, id_col: str = "id", digits: int = 4, n_docs=None) -> DataFrame:
    """``(term, df, idf)`` with ``idf = round(ln(N / df), digits)``.

    N is the number of input documents (pass ``n_docs``, e.g. :func:`n_documents`);
    by default the documents that have a token. It is a scalar subquery inside
    the same plan. (As in the reference, term frequency is not multiplied in;
    see :func:`features.tfidf` for that.)
    """
    if n_docs is None:
        n_docs = doc_terms.select(F.countDistinct(id_col)).scalar()
    dfs = doc_freq(doc_terms, id_col)
    return dfs.select("term", "df", F.round(F.ln(n_docs / F.col("df")), digits).alias("idf"))


def vocabulary(doc_terms: DataFrame, *, id_col: str = "id", no_below: int = 1,
               no_above: float = 1.0, drop_top_n: int = 0, min_count: int = 1,
               max_features: int | None = None, n_docs=None) -> DataFrame:
    """``(term, term_id, df, cf)`` after pruning, numbered by (df desc, term).

    ``no_below``: min document count; ``no_above``: max document share;
    ``drop_top_n``: remove the n terms with the highest df (after the share cut);
    ``min_count``: min collection count; ``max_features``: keep the best n by df
    (all terms, however many, without it).
    """
    if n_docs is None:
        n_docs = doc_terms.select(F.countDistinct(id_col)).scalar()
    v = doc_freq(doc_terms, id_col).where(
        (F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above) * n_docs)
        & (F.col("cf") >= min_count))
    order = [F.col("df").desc(), F.col("term").asc()]
    if drop_top_n:
        top = v.orderBy(*order).limit(drop_top_n).select(F.col("term").alias("_t"))
        v = v.join(F.broadcast(top), v["term"] == top["_t"], "left_anti")
    if max_features:
        v = v.orderBy(*order).limit(max_features)
    return numbered(v, order, "term_id").withColumn("term_id", F.col("term_id").cast("int")) \
        .select("term", "term_id", "df", "cf")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in ``order``, without one task that holds all rows.

    Rows are sorted by range and stored with their partition; a row's place is its place in the partition
    after the sizes of the partitions before it (one row per partition).
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_at", inside).join(sizes, "_part") \
                .withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


def bag_of_words(doc_terms: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, term_id, tf)``; terms outside the vocabulary are dropped (AQE picks the join by measured size)."""
    v = vocab.select(F.col("term").alias("_vt"), "term_id")
    return doc_terms.join(v, doc_terms["term"] == v["_vt"], "inner").select(id_col, "term_id", "tf")


def token_totals(doc_terms: DataFrame) -> DataFrame:
    """Total tokens and distinct terms of a corpus (one row)."""
    return doc_terms.agg(F.sum("tf").cast("bigint").alias("n_tokens"),
                         F.countDistinct("term").alias("n_terms"))
