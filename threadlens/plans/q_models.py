"""Registered queries: features, classifiers, clustering, word vectors, topics (G*)."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.functions import text as T
from threadlens.operators import classify as G
from threadlens.operators import cluster as K
from threadlens.operators import embed as WV
from threadlens.operators import features as FT
from threadlens.operators import metrics as M
from threadlens.operators import neighbours as NB
from threadlens.operators import similarity as SM
from threadlens.operators import terms as E
from threadlens.operators import topics as TP
from threadlens.operators.ranking import top_k_per_group
from threadlens.operators.sampling import split as hash_split
from threadlens.plans import sqlparts as S
from threadlens.plans.registry import query
from threadlens.session import materialize
from threadlens.sources.tables import load

W = S.with_
_DT = (f"dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term "
       f"FROM documents) GROUP BY doc_id, term)")


def _docs(spark, sf):
    return load(spark, sf, "documents")


def _doc_terms(spark, sf):
    # the (doc, term, tf) table feeds several aggregates of one plan: tokenize once
    return materialize(E.term_frequencies(_docs(spark, sf), ["doc_id"]), "doc_terms")


# ---------------------------------------------------------------- G1 tf-idf
@query("tfidf_top_terms", W(_DT, """n AS (SELECT count(*) AS n FROM documents),
st AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT dt.doc_id, dt.term, dt.tf * (ln((n.n + 1) / (st.df + 1)) + 1) AS w FROM dt JOIN st USING (term), n),
wn AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)""", body="""
SELECT doc_id, term, round(weight, 6) AS weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM wn) WHERE rank <= 10"""))
def tfidf_top_terms(spark, sf):
    w = FT.tfidf(_doc_terms(spark, sf), "doc_id", n_docs=E.n_documents(_docs(spark, sf)))
    top = top_k_per_group(w, ["doc_id"], [F.col("weight").desc(), F.col("term")], 10)
    return top.select("doc_id", "term", F.round("weight", 6).alias("weight"), "rank")


# ---------------------------------------------------------------- G2 Naive Bayes (relational) + metrics
_NB = W(_DT, f"""part AS (SELECT doc_id, lang, CASE WHEN {S.hash_bucket('doc_id')} < 70 THEN 'train' ELSE 'test' END AS part
                  FROM documents),
train AS (SELECT dt.*, p.lang FROM dt JOIN part p USING (doc_id) WHERE p.part = 'train'),
vsize AS (SELECT count(DISTINCT term) AS v FROM train),
cls AS (SELECT lang AS class, count(*) AS nd FROM part WHERE part = 'train' GROUP BY lang),
ntot AS (SELECT sum(nd) AS n FROM cls),
tok AS (SELECT lang AS class, sum(tf) AS t FROM train GROUP BY lang),
cnt AS (SELECT term, lang AS class, sum(tf) AS n FROM train GROUP BY term, lang),
test_docs AS (SELECT doc_id, lang FROM part WHERE part = 'test'),
test AS (SELECT dt.doc_id, dt.term, dt.tf FROM dt JOIN test_docs USING (doc_id)
         WHERE dt.term IN (SELECT term FROM train)),
grid AS (SELECT d.doc_id, d.lang, c.class, c.nd FROM test_docs d CROSS JOIN cls c),
ll AS (SELECT g.doc_id, g.class, sum(t.tf * ln((coalesce(k.n, 0) + 1) / (tk.t + vsize.v))) AS ll
       FROM grid g JOIN test t ON t.doc_id = g.doc_id
       LEFT JOIN cnt k ON k.term = t.term AND k.class = g.class
       JOIN tok tk ON tk.class = g.class CROSS JOIN vsize GROUP BY g.doc_id, g.class),
scores AS (SELECT g.doc_id, g.lang AS label, g.class, ln(g.nd / ntot.n) + coalesce(ll.ll, 0) AS score,
                  row_number() OVER (PARTITION BY g.doc_id ORDER BY ln(g.nd / ntot.n) + coalesce(ll.ll, 0) DESC, g.class) AS r
           FROM grid g CROSS JOIN ntot LEFT JOIN ll ON ll.doc_id = g.doc_id AND ll.class = g.class),
pred AS (SELECT doc_id, label, class AS prediction FROM scores WHERE r = 1)""", body="{body}")


def _nb(spark, sf):
    """Model and scored test documents. Texts carry their label and part, so no table of documents and terms is written or joined."""
    parts = hash_split(_docs(spark, sf).select("doc_id", "lang", "text"), 0.7, 42, "doc_id")
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    counts = E.explode_tokens(train.where("doc_id IS NOT NULL"), [F.col("lang").alias("label")]).groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    model = G.nb_fit_counts(counts, train.select(F.col("lang").alias("label")))
    return model, _nb_scored(model, E.term_frequencies_together(test, "doc_id"), test)


def _nb_scored(model, test_terms, test):
    """Every test document is scored, also one without any known term."""
    scored = G.nb_score(model, test_terms, "doc_id", ids=test.select("doc_id").distinct())
    return scored.join(test.select("doc_id", F.col("lang").alias("label")), "doc_id")


@query("nb_predict", _NB.replace("{body}", "SELECT doc_id, label, prediction FROM pred"))
def nb_predict(spark, sf):
    _, scored = _nb(spark, sf)
    return scored.select("doc_id", "label", "prediction")


@query("confusion_matrix", _NB.replace("{body}", """
SELECT label, prediction, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share
FROM pred GROUP BY label, prediction"""))
def confusion_matrix(spark, sf):
    _, scored = _nb(spark, sf)
    m = M.confusion_matrix(scored, "label", "prediction")
    return m.select("label", "prediction", "n", F.round("share", 6).alias("share"))


@query("top3_accuracy", _NB.replace("{body}", """
SELECT round(avg(hit), 6) AS top3_accuracy, count(*) AS n FROM (
  SELECT doc_id, max(CASE WHEN class = label AND r <= 3 THEN 1 ELSE 0 END) AS hit FROM scores GROUP BY doc_id)"""))
def top3_accuracy(spark, sf):
    model, scored = _nb(spark, sf)
    long = G.nb_scores_long(model, scored, "doc_id", keep=("label",))
    acc = M.top_n_accuracy(long, 3, "doc_id", "label", "class", "score")
    return acc.select(F.round("top3_accuracy", 6).alias("top3_accuracy"), "n")


@query("accuracy", _NB.replace("{body}", """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred"""))
def accuracy(spark, sf):
    _, scored = _nb(spark, sf)
    acc = M.accuracy(scored, "label", "prediction")
    return acc.select(F.round("accuracy", 6).alias("accuracy"), "n")


_STEMMED = S.stemmed_grams_ctes("documents", "doc_id", "text")


def _stemmed_parts(spark, sf):
    dt = materialize(E.stemmed_grams(_docs(spark, sf).select("doc_id", "text"), ["doc_id"]), "stemmed_grams")
    return dt, hash_split(_docs(spark, sf).select("doc_id", "lang"), 0.7, 42, "doc_id")


def _train_test(dt, parts):
    """The labels of both parts, and the vocabulary and weights of the training documents."""
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))
    return train, test, G.fit_features(_part(dt, "train"), "doc_id")


def _part(dt, part):
    """The rows of one part. It follows from the document's id, so the terms meet no other table."""
    return hash_split(dt.where("doc_id IS NOT NULL"), 0.7, 42, "doc_id").where(F.col("part") == part).drop("part")


@query("stemmed_grams_top", W(_STEMMED, body="""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY term ORDER BY cf DESC, term LIMIT 500"""))
def stemmed_grams_top(spark, sf):
    """F2 + F9 + F7: the 500 commonest 1- to 3-grams of stems."""
    return E.top_stemmed_grams(_docs(spark, sf).select("doc_id", "text"), "doc_id", 500)


@query("nb_stemmed_grams", _NB.replace(_DT, _STEMMED).replace("{body}", "SELECT doc_id, label, prediction FROM pred"))
def nb_stemmed_grams(spark, sf):
    """G2 behind the reference's features: 1- to 3-grams of stems, without a vocabulary on the driver."""
    # grams carry their document's label, so their table is grouped and scored without being joined with the documents
    docs = _docs(spark, sf)
    dt = materialize(E.stemmed_grams(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"]), "stemmed_grams")
    train, test = (hash_split(docs.select("doc_id", "lang"), 0.7, 42, "doc_id").where(F.col("part") == p) for p in ("train", "test"))
    counts = _part(dt, "train").groupBy("term", F.col("lang").alias("label")).agg(F.sum("tf").alias("n"))
    model = G.nb_fit_counts(counts, train.select(F.col("lang").alias("label")))
    scored = _nb_scored(model, _part(dt, "test"), test)
    return scored.select("doc_id", "label", "prediction")


@query("linear_hinge")
def linear_hinge(spark, sf):
    """G3 with the hinge loss over tf-idf rows of stemmed 1- to 3-grams: best class, its margin, and whether the label is in the top 3."""
    dt, parts = _stemmed_parts(spark, sf)
    train, test, features = _train_test(dt, parts)
    model = G.fit_classes(G.feature_vectors(features, _part(dt, "train"), train, "doc_id", "lang"), G.hinge())
    scores = materialize(G.all_scores(model, G.feature_vectors(features, _part(dt, "test"), test, "doc_id", "lang"), "doc_id", "rawPrediction"), "margins")
    ranked = top_k_per_group(scores, ["id"], [F.col("score").desc(), F.col("class")], 3)
    return ranked.groupBy(F.col("id").alias("doc_id")).agg(
        F.first("label").alias("label"), F.max_by("class", F.struct("score", "class")).alias("prediction"), F.max("score").alias("margin"),
        F.max((F.col("class") == F.col("label")).cast("int")).alias("in_top3"))


# ---------------------------------------------------------------- G7 k-means assignment, C11, E12, G8
_CENT = """cent AS (
  SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster, c
  FROM (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label)),
dist AS (
  SELECT e.vec_id, c.cluster,
         list_sum(list_transform(range(1, len(e.embedding) + 1),
                  lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(c.c[i] AS DOUBLE))
                          * (CAST(e.embedding[i] AS DOUBLE) - CAST(c.c[i] AS DOUBLE)))) AS d
  FROM embeddings e CROSS JOIN cent c),
assign AS (SELECT vec_id, cluster FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM dist) WHERE r = 1)"""


def _assign(spark, sf):
    emb = load(spark, sf, "embeddings")
    cents = K.first_per_label(emb, "label", "vec_id", "embedding")
    return emb, cents, emb.select("vec_id", K.nearest("embedding", cents).alias("cluster"))


@query("kmeans_assign", W(_CENT, body="SELECT vec_id, cluster FROM assign"))
def kmeans_assign(spark, sf):
    return _assign(spark, sf)[2]


_LABELS_SQL = "labels25 AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {S.lit(t)})" for i, t in enumerate(TP.TOPIC_LABELS)) + ") AS v(topic, tag))"


@query("label_topics", W(_CENT, _LABELS_SQL, body="""
SELECT a.vec_id, a.cluster AS topic, l.tag FROM assign a LEFT JOIN labels25 l ON l.topic = a.cluster"""))
def label_topics(spark, sf):
    assigned = _assign(spark, sf)[2].withColumnRenamed("cluster", "topic")
    return TP.label_topics(assigned, TP.topic_labels(spark)).select("vec_id", "topic", "tag")


@query("cluster_members", W(_CENT, body="""
SELECT cluster, count(*) AS n_members, min(vec_id) AS first_member, max(vec_id) AS last_member
FROM assign GROUP BY cluster"""))
def cluster_members(spark, sf):
    members = M.cluster_members(_assign(spark, sf)[2], "cluster", "vec_id")
    return M.cluster_summary(members)


@query("cosine_to_centroids", W(_CENT, body="""
SELECT e.vec_id, c.cluster,
       round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(c.c[i] AS DOUBLE)))
             / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                * sqrt(list_sum(list_transform(c.c, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS cosine
FROM embeddings e CROSS JOIN cent c"""))
def cosine_to_centroids(spark, sf):
    """G8 (bounded form): cosine of every vector with each fixed centroid; no all-pairs product."""
    emb, cents, _ = _assign(spark, sf)
    sims = emb.select("vec_id", F.posexplode(FT.cosine_to("embedding", cents)).alias("cluster", "cosine"))
    return sims.select("vec_id", F.col("cluster").cast("int").alias("cluster"), F.round("cosine", 6).alias("cosine"))


@query("similar_documents", W(_DT, """n AS (SELECT count(*) AS n FROM documents),
st AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT dt.doc_id, dt.term, dt.tf * (ln((n.n + 1) / (st.df + 1)) + 1) AS w FROM dt JOIN st USING (term), n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
c AS (SELECT a.doc_id AS query, b.doc_id AS id, round(sum(a.w * b.w), 9) AS cosine FROM u a JOIN u b USING (term)
      WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.5)""", body="""
SELECT query, id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM c) WHERE rank <= 10"""))
def similar_documents(spark, sf):
    """The 10 nearest documents (cosine 0.5 or more) of every document with an id divisible by 100, against all documents."""
    index = SM.build_index(_doc_terms(spark, sf), "doc_id", n_docs=E.n_documents(_docs(spark, sf)))
    found = SM.similar_documents(index, F.pmod("id", F.lit(100)) == 0, 0.5, 10)
    return found.withColumn("cosine", F.round("cosine", 6))


def _embedding_queries(spark, sf):
    rows = NB.unit_vectors(load(spark, sf, "embeddings"), "vec_id", "embedding")
    return rows, rows.where(F.pmod("id", F.lit(100)) == 0)


@query("nearest_vectors", W("""u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM (
  SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)),
c AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE a.vec_id % 100 = 0)""", body="""
SELECT query, id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM c) WHERE rank <= 10"""))
def nearest_vectors(spark, sf):
    """G8 (dense, exact): the 10 nearest embeddings of every ``vec_id`` divisible by 100, against all rows."""
    rows, queries = _embedding_queries(spark, sf)
    return NB.nearest_exact(rows, queries, 10).withColumn("cosine", F.round("cosine", 6))


@query("nearest_vectors_indexed")
def nearest_vectors_indexed(spark, sf):
    """G8 (dense): the same through the inverted-file index (approximate: as many cells are probed as a sample needs)."""
    rows, queries = _embedding_queries(spark, sf)
    return NB.nearest_indexed(NB.build_index(rows), queries, 10)


@query("nearest_vectors_recall")
def nearest_vectors_recall(spark, sf):
    """The share of the exact 10 nearest embeddings of every embedding that the index finds; it is fitted and tuned on all of them."""
    rows = materialize(NB.unit_vectors(load(spark, sf, "embeddings"), "vec_id", "embedding"), "unit")
    exact = materialize(NB.nearest_exact(rows, rows, 10), "exact")     # to tune the index and to measure it
    index = NB.build_index(rows, fit_on=None)
    return NB.recall(NB.nearest_indexed(index, rows, 10, NB.tuned_probes(index, 10, true=exact)), exact)


# ---------------------------------------------------------------- MLlib models (rows-only checks)
@query("nb_ml")
def nb_ml(spark, sf):
    """G2 (MLlib) with A14: the fitted model is saved, loaded back, and the loaded copy scores."""
    from pyspark.ml.classification import NaiveBayesModel
    from threadlens.session import scratch_path
    from threadlens.sources.sinks import save_model
    parts = hash_split(_docs(spark, sf).select("doc_id", "lang", "text"), 0.7, 42, "doc_id")
    dt = materialize(E.term_frequencies_together(parts, "doc_id", carry=["part"]), "doc_terms")
    features = G.fit_features(dt.where("doc_id IS NOT NULL AND part = 'train'"), "doc_id")
    # vectors of both parts are built at once: terms meet their numbers in one join
    vectors = G.feature_vectors(features, dt, parts, "doc_id", "lang", counts=True)
    vectors = materialize(hash_split(vectors, 0.7, 42, "doc_id"), "vectors", read_as={"features": VectorUDT()})
    train, test = (vectors.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    fitted = G.fit_classes(train, G.multinomial())
    path = scratch_path(spark, "nb_model")
    save_model(fitted.model, path)
    loaded = G.ClassModel(fitted.classes, NaiveBayesModel.load(path))
    scores = G.all_scores(loaded, test, "doc_id", "rawPrediction")
    best = F.max_by("class", F.struct("score", "class"))
    return scores.groupBy(F.col("id").alias("doc_id")).agg(F.first("label").alias("label"), best.alias("prediction"))


@query("linear_ml")
def linear_ml(spark, sf):
    """G3 + E10: tf-idf of 1-3-grams → logistic regression, the label's rank and probability among the classes."""
    toks = _docs(spark, sf).select("doc_id", T.tokens("text").alias("t"))
    dt = materialize(toks.select("doc_id", F.explode(T.ngrams_range("t", 1, 3)).alias("term"))
                     .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "grams")
    train, test, features = _train_test(dt, hash_split(_docs(spark, sf).select("doc_id", "lang"), 0.7, 42, "doc_id"))
    model = G.fit_classes(G.feature_vectors(features, _part(dt, "train"), train, "doc_id", "lang"), G.log_loss())
    long = materialize(G.all_scores(model, G.feature_vectors(features, _part(dt, "test"), test, "doc_id", "lang"), "doc_id"), "class_scores")
    ranked = top_k_per_group(long, ["id"], [F.col("score").desc(), F.col("class")], 3)
    return ranked.groupBy("id").agg(
        F.first("label").alias("label"), F.max_by("class", "score").alias("prediction"),
        F.max("score").alias("probability"), F.max((F.col("class") == F.col("label")).cast("int")).alias("in_top3")) \
        .withColumnRenamed("id", "doc_id")


@query("forest_ml")
def forest_ml(spark, sf):
    docs = _docs(spark, sf).select("doc_id", T.tokens("text").alias("tokens"))
    lab = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    data = materialize(hash_split(docs.join(lab, "doc_id"), 0.7, 42, "doc_id"))
    model = G.ml_forest("quality").fit(data.where(F.col("part") == "train"))
    pred = G.label_names(model, model.transform(data.where(F.col("part") == "test")))
    return pred.select("doc_id", F.col("quality").alias("label"), F.col("predicted_label").alias("prediction"))


@query("kmeans_ml")
def kmeans_ml(spark, sf):
    emb = load(spark, sf, "embeddings")
    _, assigned = K.kmeans_fit(emb, "embedding", k=10, seed=42)
    return assigned.select("vec_id", "cluster")


# ---------------------------------------------------------------- word vectors, topics (rows-only)
def _sentences(spark, sf):
    """F11 records: token arrays of every text of every live thread, plus titles."""
    from threadlens.operators import filters as B
    from threadlens.operators import threads as C
    from threadlens.sources.fixtures import item_texts, items
    its = items(spark, sf, text_apart=True)
    rows = C.thread_text(its, "once", texts=item_texts(spark, sf)).select("id", T.tokens("text").alias("tokens"))
    titles = B.stories(B.live(its)).select(F.col("id"), T.tokens("title").alias("tokens"))
    both = rows.select(F.lit("text").alias("kind"), "id", "tokens") \
               .unionByName(titles.select(F.lit("title").alias("kind"), "id", "tokens"))
    return materialize(both, "sentences")


def _w2v(spark, sf):
    sents = WV.subsample(_sentences(spark, sf), ["kind", "id"], "tokens", sample=1e-3)
    return WV.word_vectors(WV.word2vec_fit(sents, "tokens"))     # a stored table


@query("word2vec_vectors")
def word2vec_vectors(spark, sf):
    """Word2Vec (400 dims, min count 10, window 10, 1 iteration) over thread texts."""
    return _w2v(spark, sf).select("word", F.size("vector").alias("dims"), FT.norm2("vector").alias("norm"))


@query("word_synonyms")
def word_synonyms(spark, sf):
    """The 10 nearest words of the corpus' most frequent word."""
    vecs = _w2v(spark, sf)
    dt = E.term_frequencies(_docs(spark, sf), ["doc_id"])
    probe = E.doc_freq(dt).join(vecs.select(F.col("word").alias("term")), "term") \
        .orderBy(F.col("df").desc(), F.col("term")).limit(1).first()
    return WV.most_similar(vecs, probe["term"], 10).withColumn("probe", F.lit(probe["term"]))


@query("word_similarity")
def word_similarity(spark, sf):
    """G6 + A14: the fitted vectors saved, loaded back, and the similarity of the two most frequent words looked up."""
    from threadlens.session import scratch_path
    path = scratch_path(spark, "word_vectors")
    _w2v(spark, sf).write.parquet(path)
    vecs = spark.read.parquet(path)
    dt = E.term_frequencies(_docs(spark, sf), ["doc_id"])
    two = E.doc_freq(dt).join(vecs.select(F.col("word").alias("term")), "term") \
        .orderBy(F.col("df").desc(), F.col("term")).limit(2).collect()
    return WV.similarity(vecs, two[0]["term"], two[1]["term"])


@query("kmeans_words")
def kmeans_words(spark, sf):
    """G7 + E12: 25 clusters of word vectors; members of every cluster (summarised)."""
    vecs = _w2v(spark, sf).withColumn("wid", F.xxhash64("word"))
    _, assigned = K.kmeans_fit(vecs, "vector", k=25, seed=42)
    members = assigned.select("cluster", F.col("word").alias("member"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"),
                                          F.min("member").alias("first_member"))


def _leaf_docs(spark, sf):
    """C3 documents: per story, its title and leaf comment texts (long form)."""
    from threadlens.operators import threads as C
    from threadlens.sources.fixtures import item_texts, items
    its = items(spark, sf, text_apart=True)
    return its, C.leaf_corpus(its, item_texts(spark, sf))


def _lower_alpha(col):
    return T.tokens_alpha(F.lower(col))


@query("cluster_terms")
def cluster_terms(spark, sf):
    """G1 + G7 + G12: tf-idf of 1-3-grams (max_df .9, min_df .1, 200,000 features) → 8 clusters → 8 terms each."""
    its, leaves = _leaf_docs(spark, sf)
    grams = E.common_grams(leaves, "root_id", 0.1, tokenizer=T.tokens_alpha)
    dt = materialize(grams.counts, "grams")   # read for df and the weights
    w = materialize(FT.tfidf(dt, "root_id", min_df=0.1, max_df=0.9, max_features=200_000, n_docs=grams.n))
    # the kept terms are at most max_features (bounded), so one numbering window is fine
    vocab = materialize(w.select("term").distinct().withColumn(
        "term_id", F.row_number().over(Window.orderBy("term")) - 1))
    n_terms = vocab.count()
    long = w.join(vocab, "term").select("root_id", "term_id", "weight")
    vecs = FT.to_sparse(long, "root_id", "term_id", "weight", n_terms)
    model, _ = K.kmeans_fit(vecs, "features", k=8, seed=42)
    return K.centroid_terms(spark, model, vocab, 8)


@query("cluster_stories")
def cluster_stories(spark, sf):
    """G1 + G7 + G12 over stemmed features: 8 clusters of stories, each with its 8 heaviest terms as surface words (a gram by its
    first word) and 10 titles."""
    its, leaves = _leaf_docs(spark, sf)
    grams = E.common_grams(leaves, "root_id", 0.1, tokenizer=_lower_alpha, stemmed=True)
    dt = materialize(grams.counts, "grams")
    w = materialize(FT.tfidf(dt, "root_id", min_df=0.1, max_df=0.9, max_features=200_000, n_docs=grams.n))
    vocab = materialize(E.numbered(w.select("term").distinct(), [F.col("term")], "term_id"))
    vecs = FT.to_sparse(w.join(vocab, "term").select("root_id", "term_id", "weight"), "root_id", "term_id", "weight", vocab.count())
    model, assigned = K.kmeans_fit(vecs, "features", k=8, seed=42)
    heavy = K.centroid_terms(spark, model, vocab, 8)
    # only words of the stems that are shown are looked for in the texts
    asked = materialize(grams.words.join(heavy.select(F.element_at(F.split("term", " "), 1).alias("name")), "name", "left_semi").select("term"), "asked")
    toks = E.explode_tokens(leaves, ["root_id", "id", "part"], tokenizer=_lower_alpha, with_position=True).join(F.broadcast(asked), "term")
    words = K.surface_words(heavy, toks.select("term", F.struct("root_id", "part", "id", "pos").alias("at")))
    titles = its.where(F.col("type") == "story").select(F.col("id").alias("root_id"), "title")
    return K.cluster_summary(words, K.sample_titles(assigned, titles, "root_id", 10))


def _lda_model(spark, sf, passes=100):
    """``(vectors, vocabulary, model)`` of every live titled story's thread; the corpus is assembled once."""
    from threadlens.plans.jobs import story_terms
    from threadlens.sources.fixtures import item_texts, items
    st = materialize(story_terms(items(spark, sf, text_apart=True), texts=item_texts(spark, sf)).withColumnRenamed("root_id", "id"), "story_terms")
    vocab = materialize(E.vocabulary(st, no_below=1, no_above=0.8, drop_top_n=30), "vocabulary")
    vecs = TP.bow_vectors(E.bag_of_words(st, vocab), vocab.count())
    return vecs, vocab, TP.lda_fit(vecs, k=25, passes=passes, chunk=7000)


@query("lda_topics")
def lda_topics(spark, sf):
    """25 topics, 20 words each."""
    _, vocab, model = _lda_model(spark, sf)
    return TP.describe_topics(model, vocab, 20)


@query("tag_all_stories")
def tag_all_stories(spark, sf):
    """G10 + G11: every live titled story → thread tokens → bag of words → 3 best topics → labels."""
    vecs, _, model = _lda_model(spark, sf)
    best = TP.best_topics(model, vecs, "id", 3, 0.01)
    tags = TP.tag_documents(best, TP.topic_labels(spark), "id")
    from threadlens.session import scratch_path
    from threadlens.sources.sinks import append_tags
    store = scratch_path(spark, "tags")
    append_tags(tags, store)                      # A11: the tag store
    back = spark.read.parquet(store)
    return back.select("id", F.array_join("tag", "|").alias("tags"), F.size("tag").alias("n_tags"))


@query("tag_stream")
def tag_stream(spark, sf):
    """G10 + A14 + H2: a saved topic model (10 passes) tags two overlapping landings of stories as a stream; each story's tags, and
    whether they are those that the same model gives in batch."""
    from threadlens.operators import filters as B
    from threadlens.schema import ITEM
    from threadlens.session import scratch_path
    from threadlens.sources.fixtures import item_texts, items
    from threadlens.streaming.ingest import read_store
    from threadlens.streaming.tagging import TAGS, tag_new_stories
    base = scratch_path(spark, "tag_stream")
    vecs, vocab, model = _lda_model(spark, sf, passes=10)
    TP.save_topic_model(model, vocab, f"{base}/model", 1)
    its, texts, labels = items(spark, sf, text_apart=True), item_texts(spark, sf), TP.topic_labels(spark)
    own = items(spark, sf).where(F.col("type") == "story")
    stories = B.stories(own.select(*[f.name if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ITEM.fields]))
    for landed in (stories.where(F.pmod("id", F.lit(100)) == 0), stories):
        landed.write.mode("append").json(f"{base}/landing")
        tag_new_stories(spark, f"{base}/landing", its, f"{base}/tags", f"{base}/checkpoint", f"{base}/model", labels, ids_per_part=5000, texts=texts)
    batch = TP.tag_documents(TP.best_topics(model, vecs, "id", 3, 0.01), labels, "id").select("id", F.col("tag").alias("batch_tag"))
    tags = read_store(spark, f"{base}/tags", TAGS, ids_per_part=5000)
    same = F.coalesce(F.col("tag") == F.col("batch_tag"), F.size("tag") == 0)
    return tags.join(batch, "id", "left").select("id", F.array_join("tag", "|").alias("tags"), F.size("tag").alias("n_tags"), same.alias("same_as_batch"))


# ---------------------------------------------------------------- §3.2 supervised category flow
def _category_sql():
    toks = S.tokens("clean")
    grams = ("list_concat(t, list_transform(range(1, greatest(len(t) - 0, 1)), lambda i: t[i] || ' ' || t[i + 1]), "
             "list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))")
    return W(S.COMMENT_LINES, f"""kept AS (
  SELECT id, subreddit, translate(body, chr(10) || ',' || chr(13), '   ') AS clean FROM comment_lines
  WHERE list_contains({S.ALLOWED}, subreddit) AND body <> '[deleted]'),
bal AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY {S.hash_key('id')}, id) AS rn FROM kept)
  WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM kept GROUP BY subreddit))),
part AS (SELECT id, subreddit, CASE WHEN {S.hash_bucket('id')} < 70 THEN 'train' ELSE 'test' END AS part,
                {toks} AS t FROM bal),
dt AS (SELECT id, g AS term, count(*) AS tf FROM (SELECT id, unnest({grams}) AS g FROM part) GROUP BY id, g),
train AS (SELECT dt.*, p.subreddit AS lab FROM dt JOIN part p USING (id) WHERE p.part = 'train'),
vsize AS (SELECT count(DISTINCT term) AS v FROM train),
cls AS (SELECT subreddit AS class, count(*) AS nd FROM part WHERE part = 'train' GROUP BY subreddit),
ntot AS (SELECT sum(nd) AS n FROM cls),
tok AS (SELECT lab AS class, sum(tf) AS tt FROM train GROUP BY lab),
cnt AS (SELECT term, lab AS class, sum(tf) AS n FROM train GROUP BY term, lab),
test_docs AS (SELECT id, subreddit FROM part WHERE part = 'test'),
test AS (SELECT dt.id, dt.term, dt.tf FROM dt JOIN test_docs USING (id) WHERE dt.term IN (SELECT term FROM train)),
grid AS (SELECT d.id, d.subreddit, c.class, c.nd FROM test_docs d CROSS JOIN cls c),
ll AS (SELECT g.id, g.class, sum(t.tf * ln((coalesce(k.n, 0) + 1) / (tk.tt + vsize.v))) AS ll
       FROM grid g JOIN test t ON t.id = g.id LEFT JOIN cnt k ON k.term = t.term AND k.class = g.class
       JOIN tok tk ON tk.class = g.class CROSS JOIN vsize GROUP BY g.id, g.class),
scores AS (SELECT g.id, g.subreddit AS label, g.class,
                  row_number() OVER (PARTITION BY g.id ORDER BY ln(g.nd / ntot.n) + coalesce(ll.ll, 0) DESC, g.class) AS r
           FROM grid g CROSS JOIN ntot LEFT JOIN ll ON ll.id = g.id AND ll.class = g.class)""", body="""
SELECT round(avg(hit), 6) AS top3_accuracy, count(*) AS n FROM (
  SELECT id, max(CASE WHEN class = label AND r <= 3 THEN 1 ELSE 0 END) AS hit FROM scores GROUP BY id)""")


@query("category_top3_accuracy", _category_sql())
def category_top3_accuracy(spark, sf):
    """§3.2: comment dump → allow-list (B7) → clean (F6) → smallest-class balanced sample (E4, D5) →
    70/30 split (D6) → 1-3-gram counts (F7) → Naive Bayes (G2) → top-3 accuracy (E10)."""
    from threadlens.operators import filters as B
    from threadlens.operators.sampling import balanced_sample
    from threadlens.sources.fixtures import ALLOWED_CATEGORIES, comment_lines
    kept = B.category_filter(comment_lines(spark, sf), ALLOWED_CATEGORIES) \
        .select("id", "subreddit", T.clean_line("body").alias("clean"))
    bal = balanced_sample(kept, "subreddit", None, 42, "id")
    # the sample is drawn once; its texts carry label and part, so no table of comments and grams is written or joined
    parts = materialize(hash_split(bal, 0.7, 42, "id").select("id", "subreddit", "part", "clean"), "category_sample")
    train, test = (parts.where(F.col("part") == p) for p in ("train", "test"))

    def grams(rows, key):
        toks = rows.select(key, T.tokens("clean").alias("t0"))
        return toks.select(key, F.explode(T.ngrams_range("t0", 1, 3)).alias("term"))

    counts = grams(train, "subreddit").withColumnRenamed("subreddit", "label").groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))
    model = G.nb_fit_counts(counts, train.select(F.col("subreddit").alias("label")))
    scored = G.nb_score(model, grams(test, "id").withColumn("tf", F.lit(1)), "id", ids=test.select("id").distinct())
    long = G.nb_scores_long(model, scored, "id").join(test.select("id", F.col("subreddit").alias("label")), "id")
    acc = M.top_n_accuracy(long, 3, "id", "label", "class", "score")
    return acc.select(F.round("top3_accuracy", 6).alias("top3_accuracy"), "n")
