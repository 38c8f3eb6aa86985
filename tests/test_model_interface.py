"""Precompute, evaluate, save_only and train for every kind of model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicscope.operators.store import drop_table
from topicscope.plans.embedding_topics import DocVectorTopicModel, EmbeddingTopicModel, stored_vectors
from topicscope.plans.lifecycle import sample_cache_path, train
from topicscope.plans.precompute import precompute_predictions
from topicscope.sources import files

SCORES = {"silhouette", "calinski_harabasz", "davies_bouldin"}
TOPICS = ("gene protein cell dna", "heart blood artery valve", "river lake water flood")


@pytest.fixture(scope="module")
def articles(spark):
    rows, rng = [], random.Random(4)
    for i in range(90):
        text = " ".join(rng.choices(TOPICS[i % 3].split(), k=rng.randrange(12, 40)))
        rows.append((i, "", text, [], [], f"2020-{1 + i % 12:02d}-01", None))
    cols = "pmid long, title string, abstract string, keywords_major array<string>, keywords_minor array<string>, article_date string, date_completed string"
    df = spark.createDataFrame(rows, cols)
    return df.withColumns({c: F.col(c).cast("date") for c in ("article_date", "date_completed")})


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(3, 6)) * 5
    rows = [(i, [float(x) for x in centres[i % 3] + rng.normal(size=6) * 0.2]) for i in range(88)]
    return spark.createDataFrame([*rows, (88, None)], "doc_id long, embedding array<double>")


def use(spark, model, articles, table, query, scratch, load):
    """The life cycle of a fitted model."""
    drop_table(spark, table)
    assert precompute_predictions(spark, model, articles, table, max_new=50, batch_size=20) == 50
    assert precompute_predictions(spark, model, articles, table) == 40
    assert precompute_predictions(spark, model, articles, table, max_new=30, method="forward", overwrite=True, batch_size=20) == 30
    table_rows = spark.table(table)
    assert table_rows.count() == table_rows.select("pmid").distinct().count() == 90
    docs = articles.select(F.col("pmid").alias("doc_id"), F.col("abstract").alias("text"))
    labels = {r["pmid"]: r["label"] for r in table_rows.collect()}
    for t in range(3):  # one label for each of the three plain topics
        assert len({labels[i] for i in range(t, 87, 3)}) == 1
    assert len({labels[0], labels[1], labels[2]}) == 3
    scores = model.evaluate(docs).first().asDict()
    assert set(scores) == SCORES and scores["silhouette"] > 0.5
    given = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("label"))
    assert set(model.evaluate(docs, given).first().asDict()) == SCORES
    again = model.evaluate(model.transform(docs) if not hasattr(model, "centers") else model.transform(docs, exclude_from="clustering"), given, transformed=True)
    np.testing.assert_allclose(list(again.first()), list(model.evaluate(docs, given).first()), rtol=1e-9)
    custom = model.evaluate(docs, given, {"rows": lambda p, label, vec: p.agg(F.count(F.lit(1)))})
    assert custom.first().asDict() == {"rows": 90}
    trend = model.generate_trends(query, "month", articles, table_rows)
    assert trend.agg(F.sum("articles")).first()[0] in (29, 30)
    with pytest.raises(ValueError):
        model.save(f"{scratch}/bad", save_only=["predictions"])
    model.save(f"{scratch}/part", save_only=["config"])
    assert files.names_in(spark, f"{scratch}/part") in (["config"], ["clusterer", "config"])
    model.save(f"{scratch}/part", save_only=["model", "names"])
    back = load(f"{scratch}/part")
    assert sorted(map(tuple, back.predict(docs).collect())) == sorted(map(tuple, model.predict(docs).collect()))
    assert sorted(map(tuple, back.names.collect())) == sorted(map(tuple, model.names.collect()))
    with pytest.raises(Exception):
        model.save(f"{scratch}/part")
    model.save(f"{scratch}/part", overwrite=True)


def test_embedding_model(spark, articles, vectors, scratch):
    encoder = stored_vectors(vectors.unionByName(spark.createDataFrame([(89, [0.0] * 6)], "doc_id long, embedding array<double>")))
    cache = f"{scratch}/cache"
    model = train(spark, articles, f"{scratch}/m", 89, "forward", cache_dir=cache, model="embedding", n_components=3, min_points=5, encoder=encoder)
    assert files.exists(spark, sample_cache_path(cache, "articles", 89, "forward", 0))
    assert model.labels.filter("label = -1").count() >= 1 and model.topic_vectors.count() == 3
    back = EmbeddingTopicModel.load(spark, f"{scratch}/m", encoder)
    assert back.names.count() == 4  # noise is named as well
    with pytest.raises(ValueError):
        EmbeddingTopicModel.load(spark, f"{scratch}/m").predict(articles.select(F.col("pmid").alias("doc_id"), F.lit("x").alias("text")))
    with pytest.raises(ValueError):
        EmbeddingTopicModel().fit(vectors.filter("embedding is null"))
    first = vectors.filter("doc_id = 0").first()["embedding"]
    use(spark, model, articles, "src_emb_predictions", list(first), scratch, lambda p: EmbeddingTopicModel.load(spark, p, encoder))
    by_text = model.query_vector(spark, "a text")  # the stored vector of document 0
    assert by_text == list(first)


def test_doc_vector_model(spark, articles, scratch):
    model = train(spark, articles, f"{scratch}/m", 90, "uniform", seed=3, model="docvec", vector_size=6, min_count=1, window=3, n_components=3, min_points=5, min_cluster_size=20)
    names = [set(r["name"].split("_")) for r in model.names.collect()]
    assert all(any(n & set(t.split()) == n - (n - set(t.split())) and len(n & set(t.split())) == 4 for t in TOPICS) for n in names)
    assert model.query_topics(spark, "heart valve", 1).first()["similarity"] > 0.9
    use(spark, model, articles, "src_dv_predictions", "heart valve", scratch, lambda p: DocVectorTopicModel.load(spark, p))


def test_scores_of_single_points_and_single_clusters(spark):
    from topicscope.operators.evaluate import evaluate_clusters

    rows = [(0, [0.0, 0.0]), (0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "label int, embedding array<double>")
    # single points score 0, points on their centre 1; no scatter: 1 and 0
    assert evaluate_clusters(df).first().asDict() == {"silhouette": 0.5, "calinski_harabasz": 1.0, "davies_bouldin": 0.0}
    apart = spark.createDataFrame([(0, [0.0]), (0, [2.0])], "label int, embedding array<double>")
    assert evaluate_clusters(apart).first()["calinski_harabasz"] is None


def test_unknown_model(spark, articles):
    with pytest.raises(ValueError):
        train(spark, articles, "/nowhere", model="lda")
