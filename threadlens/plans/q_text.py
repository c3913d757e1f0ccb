"""Registered queries: sampling and ranking (D*), aggregations (E*), text functions (F*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.functions.snowball import snowball_stems
from threadlens.functions.stem import stem_vocabulary
from threadlens.operators import filters as B
from threadlens.operators import metrics as M
from threadlens.operators import ranking as R
from threadlens.operators import sampling as D
from threadlens.operators import sentences as SN
from threadlens.operators import terms as E
from threadlens.operators import threads as C
from threadlens.plans import sqlparts as S
from threadlens.plans.registry import query
from threadlens.session import materialize
from threadlens.sources.fixtures import item_texts, items
from threadlens.sources.tables import load

W = S.with_
IT = S.items_cte()
_LIVE_STORIES = f"live_stories AS (SELECT * FROM items WHERE {S.LIVE} AND type = 'story' AND title IS NOT NULL)"


def _docs(spark, sf):
    return load(spark, sf, "documents")


def _joined(tokens_col):
    return F.md5(F.array_join(tokens_col, " "))


# ---------------------------------------------------------------- D: order and sampling
@query("rank_by_score", W(IT, _LIVE_STORIES, body="SELECT id, score FROM live_stories"))
def rank_by_score(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    return R.rank_by(st, "score").select("id", "score")


@query("top_n_stories", W(IT, _LIVE_STORIES,
                          body="SELECT id, score FROM live_stories ORDER BY score DESC, id LIMIT 10"))
def top_n_stories(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    return R.top_n(st, 10, "score").select("id", "score")


@query("sample_n", W(IT, _LIVE_STORIES, body=f"""
SELECT id FROM live_stories ORDER BY {S.hash_key('id')}, id LIMIT 25"""))
def sample_n(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    return D.sample_n(st.select("id"), 25, 42)


_DRAWN = f"""drawn AS (
  SELECT range AS id FROM range(0, (SELECT max(id) + 1 FROM items))
  ORDER BY {S.hash_key('range')}, range LIMIT 2000
)"""


@query("sample_stories", W(S.items_cte(presence=True), _DRAWN,
                           "live_nodes AS (SELECT * FROM items WHERE deleted IS NULL AND dead IS NULL)",
                           "roots AS (SELECT * FROM live_nodes WHERE type = 'story' AND title IS NOT NULL "
                           "AND id IN (SELECT id FROM drawn))",
                           S.tree_cte("live_nodes", "roots"),
                           body="SELECT root_id, id, depth FROM tree", recursive=True))
def sample_stories(spark, sf):
    its = items(spark, sf, presence=True, with_text=False)
    return D.sample_stories(spark, its, 2000, 42).select("root_id", "id", "depth")


@query("balanced_sample", f"""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {S.hash_key('doc_id')}, doc_id) AS rn
  FROM documents)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))""")
def balanced_sample(spark, sf):
    """E4 + D5: as many documents per language as the smallest language has."""
    return D.balanced_sample(_docs(spark, sf), "lang", None, 42, "doc_id").select("doc_id", "lang")


@query("split", f"""
SELECT doc_id, CASE WHEN {S.hash_bucket('doc_id')} < 70 THEN 'train' ELSE 'test' END AS part FROM documents""")
def split(spark, sf):
    return D.split(_docs(spark, sf), 0.7, 42, "doc_id").select("doc_id", "part")


@query("sample_large", f"""
SELECT event_id AS id FROM events ORDER BY {S.hash_key('event_id')}, event_id LIMIT (SELECT count(*) * 2 // 5 FROM events)""")
def sample_large(spark, sf):
    """D3 for a large n: two fifths of all items, exactly, by the key of the last one."""
    its = items(spark, sf, with_text=False)
    return D.sample_n(its.select("id"), its.count() * 2 // 5, 42, small=100)


@query("split_exact", f"""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {S.hash_key('doc_id')}, doc_id)
       <= round(count(*) OVER (PARTITION BY lang) * 0.7) THEN 'train' ELSE 'test' END AS part FROM documents""")
def split_exact(spark, sf):
    """D6 with exact sizes: 70 % of each language's documents."""
    return D.split_exact(_docs(spark, sf).select("doc_id", "lang"), 0.7, 42, "doc_id", ["lang"])


@query("fixed_samples", W(S.items_cte(descendants=True), body="""
SELECT position, id FROM (
  SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM items
  WHERE type = 'story' AND descendants > 30) WHERE position IN (28, 52, 122)"""))
def fixed_samples(spark, sf):
    st = items(spark, sf, with_text=False, with_descendants=True).where(F.col("type") == "story")
    return D.fixed_samples(B.min_descendants(st, 30).select("id"), [28, 52, 122]).select("position", "id")


_DOC_TERMS = f"doc_terms AS (SELECT doc_id, source, lang, unnest({S.tokens('text')}) AS term FROM documents)"


@query("top_words_per_source", W(_DOC_TERMS, body="""
SELECT source, word, freq, rank FROM (
  SELECT source, term AS word, count(*) AS freq,
         row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS rank
  FROM doc_terms GROUP BY source, term) WHERE rank <= 20"""))
def top_words_per_source(spark, sf):
    wf = E.word_freq(_docs(spark, sf), ["source"])
    return R.top_k_per_group(wf, ["source"], [F.col("freq").desc(), F.col("word")], 20) \
            .select("source", "word", "freq", "rank")


# ---------------------------------------------------------------- E: aggregations
_LIVE_NODES = f"live_nodes AS (SELECT * FROM items WHERE {S.LIVE})"
_THREAD_TREE = S.tree_cte("live_nodes", "live_roots")
_LIVE_ROOTS = "live_roots AS (SELECT * FROM live_nodes WHERE type = 'story')"


@query("thread_word_freq", W(IT, _LIVE_NODES, _LIVE_ROOTS, _THREAD_TREE, f"""thread_terms AS (
  SELECT t.root_id, unnest({S.tokens('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND i.text <> '')""", body="""
SELECT root_id, word, freq, rank FROM (
  SELECT root_id, term AS word, count(*) AS freq,
         row_number() OVER (PARTITION BY root_id ORDER BY count(*) DESC, term) AS rank
  FROM thread_terms GROUP BY root_id, term) WHERE rank <= 20""", recursive=True))
def thread_word_freq(spark, sf):
    """Flagship: live threads → all their text → tokens → top 20 words per story."""
    rows = C.thread_text(items(spark, sf, text_apart=True), "once", texts=item_texts(spark, sf))
    wf = E.word_freq(rows, ["root_id"], together=True)
    return R.top_k_per_group(wf, ["root_id"], [F.col("freq").desc(), F.col("word")], 20) \
            .select("root_id", "word", "freq", "rank")


_STORY_ROOTS = "story_roots AS (SELECT * FROM items WHERE type = 'story' AND descendants > 0)"


@query("word_freq_stories", W(S.items_cte(descendants=True), _STORY_ROOTS,
                              S.tree_cte("items", "story_roots"), f"""story_terms AS (
  SELECT t.root_id, unnest({S.tokens_freq('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE))""", body="""
SELECT id, word, freq, rank FROM (
  SELECT root_id AS id, term AS word, count(*) AS freq,
         row_number() OVER (PARTITION BY root_id ORDER BY count(*) DESC, term) AS rank
  FROM story_terms GROUP BY root_id, term) WHERE rank <= 20""", recursive=True))
def word_freq_stories(spark, sf):
    """Word-frequency job: stories with comments → every comment's text → counts (top 20 per story)."""
    its = items(spark, sf, with_descendants=True, text_apart=True)
    st = B.min_descendants(its.where(F.col("type") == "story"), 0)
    rows = C.comment_corpus(its, st, item_texts(spark, sf))
    wf = E.word_freq(rows, ["root_id"], tokenizer=T.tokens_freq, together=True).withColumnRenamed("root_id", "id")
    return R.top_k_per_group(wf, ["id"], [F.col("freq").desc(), F.col("word")], 20) \
            .select("id", "word", "freq", "rank")


@query("term_count", f"SELECT doc_id, len(list_filter({S.tokens('text')}, lambda t: t = 'de')) AS n FROM documents")
def term_count(spark, sf):
    docs = _docs(spark, sf).select("doc_id", T.tokens("text").alias("tokens"))
    return docs.select("doc_id", E.term_count("tokens", "de").alias("n"))


@query("category_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def category_counts(spark, sf):
    return M.category_counts(_docs(spark, sf), "source")


@query("min_category", """
SELECT lang, count(*) AS n FROM documents GROUP BY lang
HAVING count(*) = (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))""")
def min_category(spark, sf):
    return M.min_category(_docs(spark, sf), "lang")


CROSS_WORDS = ["der", "die", "und", "de", "la", "que", "le", "et", "th", "er"]


@query("crosstab", W(_DOC_TERMS, body="SELECT lang, " + ", ".join(
    f"count(*) FILTER (WHERE term = {S.lit(w)}) AS {w}" for w in CROSS_WORDS) + " FROM doc_terms GROUP BY lang"))
def crosstab(spark, sf):
    toks = E.explode_tokens(_docs(spark, sf), ["lang"])
    out = M.crosstab(toks, "lang", "term", CROSS_WORDS)
    return out.select("lang", *[F.col(w).cast("bigint").alias(w) for w in CROSS_WORDS])


@query("nest_vocabulary", W(S.items_cte(descendants=True), _STORY_ROOTS,
                            S.tree_cte("items", "story_roots"), f"""story_terms AS (
  SELECT t.root_id, unnest({S.tokens_freq('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE)),
freq AS (SELECT root_id, term, count(*) AS freq FROM story_terms GROUP BY root_id, term)""", body="""
SELECT f.root_id AS id, md5(s.title) AS title_md5, count(*) AS n_words,
       string_agg(f.term || ':' || CAST(f.freq AS VARCHAR), ',' ORDER BY f.freq DESC, f.term) AS vocabulary
FROM freq f JOIN items s ON s.id = f.root_id GROUP BY f.root_id, s.title""", recursive=True))
def nest_vocabulary(spark, sf):
    """A10: one nested record per story: ``vocabulary = [(word, freq)]`` sorted by freq desc, word."""
    from threadlens.sources.sinks import nest_vocabulary as nest
    its = items(spark, sf, with_descendants=True, text_apart=True)
    st = B.min_descendants(its.where(F.col("type") == "story"), 0)
    wf = E.word_freq(C.comment_corpus(its, st, item_texts(spark, sf)), ["root_id"], tokenizer=T.tokens_freq, together=True) \
          .withColumnRenamed("root_id", "id")
    nested = nest(wf, st.select("id", "title"))
    return nested.select(
        "id", F.md5("title").alias("title_md5"), F.size("vocabulary").alias("n_words"),
        F.array_join(F.transform("vocabulary", lambda v: F.concat(v["word"], F.lit(":"), v["freq"].cast("string"))),
                     ",").alias("vocabulary"))


@query("vocabulary_parts", W(S.items_cte(descendants=True), _STORY_ROOTS,
                             S.tree_cte("items", "story_roots"), f"""story_terms AS (
  SELECT t.root_id, unnest({S.tokens_freq('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE)),
freq AS (SELECT root_id, term, count(*) AS freq FROM story_terms GROUP BY root_id, term),
placed AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY freq DESC, term) - 1 AS n FROM freq)""", body="""
SELECT f.root_id AS id, CAST(n // 500 AS INTEGER) AS part, count(*) AS n_words,
       md5(string_agg(f.term || ':' || CAST(f.freq AS VARCHAR), ',' ORDER BY n)) AS vocabulary_md5
FROM placed f GROUP BY f.root_id, n // 500""", recursive=True))
def vocabulary_parts(spark, sf):
    """A10 in rows of at most 500 words."""
    from threadlens.sources.sinks import nest_vocabulary_parts
    its = items(spark, sf, with_descendants=True, text_apart=True)
    st = B.min_descendants(its.where(F.col("type") == "story"), 0)
    wf = E.word_freq(C.comment_corpus(its, st, item_texts(spark, sf)), ["root_id"], tokenizer=T.tokens_freq, together=True).withColumnRenamed("root_id", "id")
    words = F.transform("vocabulary", lambda v: F.concat(v["word"], F.lit(":"), v["freq"].cast("string")))
    return nest_vocabulary_parts(wf, st.select("id", "title"), 500).select(
        "id", "part", F.size("vocabulary").cast("bigint").alias("n_words"), F.md5(F.array_join(words, ",")).alias("vocabulary_md5"))


_DT = f"dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY doc_id, term)"


def _doc_terms(spark, sf):
    # the (doc, term, tf) table feeds several aggregates of one plan: tokenize once
    return materialize(E.term_frequencies(_docs(spark, sf), ["doc_id"]), "doc_terms")


@query("idf_documents", W(_DT, body="""
SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 4) AS idf
FROM dt GROUP BY term"""))
def idf_documents(spark, sf):
    dt = E.term_frequencies(_docs(spark, sf), ["doc_id"])        # read once: not worth a table
    return E.idf(dt, "doc_id", n_docs=E.n_documents(_docs(spark, sf)))


_VOCAB = """stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY term),
kept AS (SELECT * FROM stats WHERE df >= 2 AND df <= 0.8 * (SELECT count(*) FROM documents)),
top30 AS (SELECT term FROM kept ORDER BY df DESC, term LIMIT 30),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_id, df, cf
          FROM (SELECT * FROM kept WHERE term NOT IN (SELECT term FROM top30) ORDER BY df DESC, term LIMIT 2000))"""


def _vocab(spark, sf, dt=None):
    dt = dt if dt is not None else _doc_terms(spark, sf)
    return E.vocabulary(dt, id_col="doc_id", no_below=2, no_above=0.8, drop_top_n=30, max_features=2000,
                        n_docs=E.n_documents(_docs(spark, sf)))


@query("vocabulary", W(_DT, _VOCAB, body="SELECT term, term_id, df, cf FROM vocab"))
def vocabulary(spark, sf):
    return _vocab(spark, sf)


@query("bag_of_words", W(_DT, _VOCAB, body="""
SELECT dt.doc_id, v.term_id, CAST(dt.tf AS BIGINT) AS tf FROM dt JOIN vocab v ON v.term = dt.term"""))
def bag_of_words(spark, sf):
    dt = _doc_terms(spark, sf)
    return E.bag_of_words(dt, _vocab(spark, sf, dt), "doc_id")


@query("token_totals", W(_DT, body="SELECT CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms FROM dt"))
def token_totals(spark, sf):
    return E.token_totals(E.term_frequencies(_docs(spark, sf), ["doc_id"]))


@query("all_comments", W(S.items_cte(descendants=True), _STORY_ROOTS, S.tree_cte("items", "story_roots"), body="""
SELECT t.id, length(i.text) AS text_len FROM tree t JOIN items i ON i.id = t.id
WHERE i.text IS NOT NULL AND NOT coalesce(i.dead, FALSE)""", recursive=True))
def all_comments(spark, sf):
    """Every comment text below the stories of the range, ungrouped."""
    its = items(spark, sf, with_descendants=True, text_apart=True)
    st = B.min_descendants(its.where(F.col("type") == "story"), 0)
    return C.comment_corpus(its, st, item_texts(spark, sf)).select("id", F.length("text").alias("text_len"))


# ---------------------------------------------------------------- F: text functions
@query("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                   f"FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokenize(spark, sf):
    t = T.tokens("text")
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), _joined(t).alias("tokens_md5"))


@query("tokenize_freq", f"SELECT page_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                        f"FROM (SELECT page_id, {S.tokens_freq('html')} AS t FROM pages)")
def tokenize_freq(spark, sf):
    t = T.tokens_freq("html")
    return load(spark, sf, "pages").select("page_id", F.size(t).alias("n_tokens"), _joined(t).alias("tokens_md5"))


@query("tokenize_freq_legacy", f"SELECT page_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                               f"FROM (SELECT page_id, {S.tokens_freq('html', legacy=True)} AS t FROM pages)")
def tokenize_freq_legacy(spark, sf):
    t = T.tokens_freq("html", legacy_order=True)
    return load(spark, sf, "pages").select("page_id", F.size(t).alias("n_tokens"), _joined(t).alias("tokens_md5"))


@query("tokenize_plain", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 "
                         f"FROM (SELECT doc_id, {S.tokens_plain('text')} AS t FROM documents)")
def tokenize_plain(spark, sf):
    t = T.tokens_plain("text")
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), _joined(t).alias("tokens_md5"))


@query("tokenize_alpha", f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5,
       md5(array_to_string(list_transform(t, lambda x: {S.stem('lower(x)')}), ' ')) AS stems_md5
FROM (SELECT doc_id, {S.tokens_alpha('text')} AS t FROM documents)""")
def tokenize_alpha(spark, sf):
    docs = _docs(spark, sf).select("doc_id", T.tokens_alpha("text").alias("t"))
    docs = materialize(docs, "tokens")
    toks = docs.select("doc_id", F.posexplode("t").alias("pos", "word")).withColumn("term", F.lower("word"))
    stems = toks.join(stem_vocabulary(toks), "term").groupBy("doc_id") \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("s"))      # one text's words
    own = F.coalesce(F.col("s.stem"), F.array().cast("array<string>"))
    return docs.join(stems, "doc_id", "left").select("doc_id", F.size("t").alias("n_tokens"), _joined(F.col("t")).alias("tokens_md5"),
                                                     _joined(own).alias("stems_md5"))


@query("unescape_html", f"SELECT page_id, md5({S.unescape('html')}) AS html_md5 FROM pages")
def unescape_html(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(T.unescape_html("html")).alias("html_md5"))


@query("clean_line", "SELECT doc_id, md5(translate(text, chr(10) || ',' || chr(13), '   ')) AS text_md5 FROM documents")
def clean_line(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean_line("text")).alias("text_md5"))


def _ngram_sql(n):
    return (f"SELECT {n} AS n, g AS gram FROM (SELECT t FROM (SELECT {S.tokens('text')} AS t FROM documents) "
            f"WHERE len(t) >= {n}), unnest(list_transform(range(1, len(t) - {n - 2}), "
            f"lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS u(g)")


@query("ngrams_top", f"""
SELECT n, gram, cnt, rank FROM (
  SELECT n, gram, count(*) AS cnt, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, gram) AS rank
  FROM ({_ngram_sql(1)} UNION ALL {_ngram_sql(2)} UNION ALL {_ngram_sql(3)}) GROUP BY n, gram
) WHERE rank <= 25""")
def ngrams_top(spark, sf):
    """the 25 commonest grams of each length, 1 to 3."""
    return E.top_grams(_docs(spark, sf), 25)


@query("stem_terms", W(_DT, body=f"SELECT term, {S.stem('term')} AS stem FROM (SELECT DISTINCT term FROM dt)"))
def stem_terms(spark, sf):
    return stem_vocabulary(E.explode_tokens(_docs(spark, sf), []))


@query("snowball_terms", W(_DT, S.snowball_ctes("SELECT term FROM dt"), body="SELECT term, stem FROM stems"))
def snowball_terms(spark, sf):
    """the Snowball English stem of every distinct term."""
    return snowball_stems(E.explode_tokens(_docs(spark, sf), []))


@query("stem_to_word", f"""
SELECT stem, arg_min(term, doc_id * 1000000 + pos) AS word FROM (
  SELECT doc_id, pos, term, {S.stem('term')} AS stem FROM (
    SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))
) GROUP BY stem""")
def stem_to_word(spark, sf):
    """Each stem with the first surface word that produced it (document, position order)."""
    toks = E.explode_tokens(_docs(spark, sf), ["doc_id"], with_position=True)
    first = toks.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))   # one row per distinct term
    stems = stem_vocabulary(first)
    return first.join(stems, "term").groupBy("stem").agg(F.min_by("term", "at").alias("word"))


_SENTENCES = S.sentence_ctes("documents", "doc_id", "text")


@query("sentence_counts", W(_SENTENCES, body="""
SELECT doc_id, count(*) FILTER (WHERE ends) AS n_sentences,
       md5(string_agg(piece || CASE WHEN ends THEN chr(10) ELSE ' ' END, '' ORDER BY pos)) AS sentences_md5
FROM ended GROUP BY doc_id"""))
def sentence_counts(spark, sf):
    """each document's sentences, split by statistics of the whole corpus (documents with a word)."""
    s = SN.split_sentences(_docs(spark, sf).select("doc_id", "text"), ["doc_id"])
    lines = F.array_sort(F.collect_list(F.struct("sentence_no", "sentence")))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.md5(F.concat(
        F.array_join(lines.getField("sentence"), "\n"), F.lit("\n"))).alias("sentences_md5"))


@query("abbreviations", W(_SENTENCES, body=f"""
SELECT type, dotted, plain, round(score, 3) AS score FROM abbr WHERE score >= {SN.ABBREVIATION}"""))
def abbreviations(spark, sf):
    """the types that look like abbreviations, with their counts with and without a period."""
    found = SN.abbreviations(SN.chunks(_docs(spark, sf), ["doc_id"]))
    return found.where(F.col("score") >= SN.ABBREVIATION).withColumn("score", F.round("score", 3))


@query("title_tokens", W(IT, _LIVE_STORIES, body=f"""
SELECT id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT id, {S.tokens('title')} AS t FROM live_stories)"""))
def title_tokens(spark, sf):
    st = B.stories(B.live(items(spark, sf, with_text=False)))
    t = T.tokens("title")
    return st.select("id", F.size(t).alias("n_tokens"), _joined(t).alias("tokens_md5"))


@query("record_tokens", W(IT, _LIVE_NODES, _LIVE_ROOTS, _THREAD_TREE, body=f"""
SELECT t.id, 'text' AS kind, len({S.tokens('i.text')}) AS n_tokens,
       md5(array_to_string({S.tokens('i.text')}, ' ')) AS tokens_md5
FROM tree t JOIN items i ON i.id = t.id WHERE i.text IS NOT NULL AND i.text <> ''
UNION ALL
SELECT id, 'title' AS kind, len({S.tokens('title')}) AS n_tokens, md5(array_to_string({S.tokens('title')}, ' '))
FROM live_roots WHERE title IS NOT NULL""", recursive=True))
def record_tokens(spark, sf):
    """one token list per text of a live thread and one per title (Word2Vec sentences)."""
    its = items(spark, sf, text_apart=True)
    rows = C.thread_text(its, "once", texts=item_texts(spark, sf)).select("id", F.lit("text").alias("kind"), T.tokens("text").alias("t"))
    titles = B.stories(B.live(its)).select("id", F.lit("title").alias("kind"), T.tokens("title").alias("t"))
    both = rows.unionByName(titles)
    return both.select("id", "kind", F.size("t").alias("n_tokens"), _joined(F.col("t")).alias("tokens_md5"))


@query("story_tokens", W(IT, _LIVE_NODES, _LIVE_ROOTS, _THREAD_TREE, f"""st AS (
  SELECT t.root_id, unnest({S.tokens('i.text')}) AS term FROM tree t JOIN items i ON i.id = t.id
  WHERE i.text IS NOT NULL AND i.text <> ''
  UNION ALL
  SELECT id AS root_id, unnest({S.tokens('title')}) AS term FROM live_roots WHERE title IS NOT NULL)""", body="""
SELECT root_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM st GROUP BY root_id""",
    recursive=True))
def story_tokens(spark, sf):
    """per story, the tokens of all its thread text plus its title (long form, summarised)."""
    from threadlens.plans.jobs import story_terms
    st = story_terms(items(spark, sf, text_apart=True), texts=item_texts(spark, sf))
    return st.groupBy("root_id").agg(F.sum("tf").cast("bigint").alias("n_tokens"),
                                     F.count(F.lit(1)).alias("n_terms"))
