"""Topic models: what is learned, tagged, saved and loaded again (G9-G11, A11, A14) on the small tables, k and words as in production."""

import pytest
from pyspark.sql import functions as F

from threadlens.operators import topics as TP
from threadlens.plans import catalog, q_models
from threadlens.sources.sinks import append_tags

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    return q_models._lda_model(spark, SF, passes=5)


def test_topics(fitted):
    vecs, vocab, model = fitted
    rows = TP.describe_topics(model, vocab, 20).collect()
    known = {r.term for r in vocab.collect()}
    assert len(rows) == 25 * 20 and {r.topic for r in rows} == set(range(25)) and {r.term for r in rows} <= known
    for t in range(25):
        weights = [r.weight for r in sorted((r for r in rows if r.topic == t), key=lambda r: r["rank"])]
        assert weights == sorted(weights, reverse=True) and 0 < sum(weights) <= 1 + 1e-9
        assert len({r.term for r in rows if r.topic == t}) == 20
    shares = model.transform(vecs).select(F.aggregate(TP.vector_to_array("topics"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert shares and all(abs(r.s - 1) < 1e-6 for r in shares)


def test_tags(spark, fitted, tmp_path):
    vecs, _, model = fitted
    best = TP.best_topics(model, vecs, "id", 3, 0.01).collect()
    assert len(best) > vecs.count() / 2 and all(r.prob >= 0.01 for r in best)
    tags = TP.tag_documents(TP.best_topics(model, vecs, "id", 3, 0.01), TP.topic_labels(spark), "id")
    append_tags(tags, str(tmp_path / "tags"))
    back = spark.read.parquet(str(tmp_path / "tags")).collect()
    by_id = {}
    for r in best:
        by_id.setdefault(r.id, []).append((-r.prob, r.topic))
    assert {r.id: r.tag for r in back} == {i: [TP.TOPIC_LABELS[t] for _, t in sorted(v)] for i, v in by_id.items()}
    assert all(1 <= len(r.tag) <= 3 and set(r.tag) <= set(TP.TOPIC_LABELS) for r in back)


def test_saved_model_is_the_model(spark, fitted, tmp_path):
    vecs, vocab, model = fitted
    path = str(tmp_path / "models")
    assert TP.saved_versions(spark, path) == {}
    with pytest.raises(ValueError):
        TP.load_topic_model(spark, path)
    for version in (1, 3):
        TP.save_topic_model(model, vocab, path, version)
    with pytest.raises(ValueError):
        TP.save_topic_model(model, vocab, path, 3)
    saved = TP.load_topic_model(spark, path)
    assert (saved.version, saved.vocab_size) == (3, vocab.count()) and TP.load_topic_model(spark, path, 1).version == 1
    assert sorted(saved.vocab.collect()) == sorted(vocab.collect())
    assert sorted(TP.describe_topics(saved.model, saved.vocab).collect()) == sorted(TP.describe_topics(model, vocab).collect())
    first = sorted(TP.best_topics(model, vecs).collect())
    assert sorted(TP.best_topics(saved.model, vecs).collect()) == first and first


def test_stream_tags_each_story_once(spark):
    rows = catalog.QUERIES["tag_stream"](spark, SF).collect()
    stories = catalog.QUERIES["live_stories"](spark, SF).count()
    assert len(rows) == len({r.id for r in rows}) == stories > 10
    assert all(r.same_as_batch and r.n_tags <= 3 for r in rows) and any(r.n_tags for r in rows)
