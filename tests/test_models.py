import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicscope.operators.store import drop_table

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs(spark):
    from topicscope.sources.tables import read_table

    return read_table(spark, SF_SMALL, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(spark, docs):
    from topicscope.plans.topics import TfidfTopicModel

    return TfidfTopicModel(min_df=0.02, max_df=0.5, n_components=8, n_clusters=4, random_state=42).fit(docs)


def test_shapes(model, docs):
    n = docs.count()
    assert {len(r["v"]) for r in model.components.collect()} == {8}
    assert model.components.count() == model.vocab.count()
    assert model.centers.shape == (4, 8)
    reduced = model.transform(docs, exclude_from="clustering")
    assert reduced.count() == n
    assert {len(r["vector"]) for r in reduced.collect()} == {8}
    dist = model.transform(docs)
    assert {len(r["distances"]) for r in dist.collect()} == {4}
    x = model.transform(docs, last_step="vectorize")
    assert set(x.columns) == {"doc_id", "idx", "w"}
    with pytest.raises(ValueError):
        model.transform(docs, last_step="nope")


def test_svd_matches_numpy(spark, model, docs):
    x = model.transform(docs, last_step="vectorize").collect()
    d = model.vocab.count()
    ids = sorted({r["doc_id"] for r in x})
    pos = {k: i for i, k in enumerate(ids)}
    dense = np.zeros((len(ids), d))
    for r in x:
        dense[pos[r["doc_id"]], r["idx"]] = r["w"]
    s = np.linalg.svd(dense, compute_uv=False)
    np.testing.assert_allclose(model.singular_values[:3], s[:3], rtol=1e-6)


def test_predict_and_names(model, docs):
    p = model.predict(docs)
    # the JVM k-means transform and the column-expression scoring agree
    km, model.kmeans = model.kmeans, None
    try:
        by_expr = sorted(map(tuple, model.predict(docs).collect()))
    finally:
        model.kmeans = km
    assert sorted(map(tuple, p.collect())) == by_expr
    assert p.count() == docs.count()
    assert set(r["label"] for r in p.collect()) <= set(range(4))
    names = {r["label"]: r["name"] for r in model.names.collect()}
    assert all(len(v.split(", ")) == 3 for v in names.values())


def test_save_load_same_predictions(spark, model, docs, scratch):
    from topicscope.plans.topics import TfidfTopicModel

    path = os.path.join(scratch, "m")
    model.save(path)
    with pytest.raises(Exception):
        model.save(path)
    model.save(path, overwrite=True)
    back = TfidfTopicModel.load(spark, path)
    a = sorted(tuple(r) for r in model.predict(docs).collect())
    b = sorted(tuple(r) for r in back.predict(docs).collect())
    assert a == b


def test_evaluate_scores(model, docs):
    r = model.evaluate(docs).first().asDict()
    assert set(r) == {"silhouette", "calinski_harabasz", "davies_bouldin"}
    assert -1 <= r["silhouette"] <= 1


def test_precompute_cap_and_no_repeat(spark, model, scratch):
    from topicscope.plans.precompute import precompute_predictions
    from topicscope.sources.tables import articles_view

    drop_table(spark, "preds_test")
    arts = articles_view(spark, SF_SMALL).drop("label")
    n1 = precompute_predictions(spark, model, arts, "preds_test", max_new=50, method="uniform", seed=1)
    assert n1 == 50
    n2 = precompute_predictions(spark, model, arts, "preds_test")
    total = arts.count()
    assert n1 + n2 == total
    assert spark.table("preds_test").select("pmid").distinct().count() == total
    assert precompute_predictions(spark, model, arts, "preds_test") == 0

    from topicscope.sources.ndjson import export_predictions, import_predictions

    out = os.path.join(scratch, "preds_json")
    export_predictions(spark, "preds_test", out)
    drop_table(spark, "preds_copy")
    back = import_predictions(spark, "preds_copy", filepath=out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spark.table("preds_test").collect()))
    with pytest.raises(ValueError):
        import_predictions(spark, "preds_copy")

    trend = model.generate_trends("de la", "month", arts, spark.table("preds_test"), closest_n=2)
    assert trend.count() > 0
    assert set(trend.columns) == {"date", "label", "articles"}


def test_precompute_batches_and_timeout(spark, model):
    from topicscope.plans.precompute import precompute_predictions
    from topicscope.sources.tables import articles_view

    arts = articles_view(spark, SF_SMALL).drop("label")
    drop_table(spark, "preds_batched")
    # a timeout that is over stops after the first batch
    assert precompute_predictions(spark, model, arts, "preds_batched", batch_size=40, timeout=1e-6) == 40
    for bad in ({"timeout": 0}, {"max_new": 0}, {"batch_size": -1}):
        with pytest.raises(ValueError):
            precompute_predictions(spark, model, arts, "preds_batched", **bad)
    n = precompute_predictions(spark, model, arts, "preds_batched", batch_size=70, max_new=100)
    assert n == 100
    rest = precompute_predictions(spark, model, arts, "preds_batched", batch_size=1000)
    assert 40 + n + rest == arts.count()
    # a capped overwrite labels again and keeps the others
    assert precompute_predictions(spark, model, arts, "preds_batched", max_new=5, overwrite=True) == 5
    assert spark.table("preds_batched").count() == spark.table("preds_batched").select("pmid").distinct().count() == arts.count()
    plan = spark.table("preds_batched").filter("label = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan


def test_labelling_stream_twice_adds_nothing(spark, model, scratch):
    from topicscope.sources.tables import articles_view
    from topicscope.streaming.labelling import run_labelling_stream

    src = os.path.join(scratch, "arts")
    articles_view(spark, SF_SMALL).drop("label").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    drop_table(spark, "preds_stream")
    ck = os.path.join(scratch, "ck")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    n = run_labelling_stream(spark, stream, model, "preds_stream", ck, spark.read.parquet(src))
    assert n == spark.read.parquet(src).count()
    stream = spark.readStream.schema(schema).parquet(src)
    assert run_labelling_stream(spark, stream, model, "preds_stream", ck, spark.read.parquet(src)) == 0
    # dates are those of the whole corpus, whatever the micro-batches
    from topicscope.operators.trends import with_reconstructed_date

    want = with_reconstructed_date(spark.read.parquet(src)).select("pmid", "date")
    assert spark.table("preds_stream").select("pmid", "date").exceptAll(want).isEmpty()


@pytest.mark.parametrize("unit", ["week", "month", "year"])
def test_event_trend_appends_coarse_buckets(spark, scratch, unit):
    from pyspark.sql import functions as F

    from topicscope.sources.tables import read_table
    from topicscope.streaming.trends import event_trend, rolled_up

    ev = read_table(spark, SF_SMALL, "events")
    src, out = os.path.join(scratch, "events"), os.path.join(scratch, "out")
    # a last event far ahead lets the watermark close every earlier bucket
    late = ev.limit(1).withColumn("ts", F.expr("cast('2100-01-01' as timestamp)").cast(ev.schema["ts"].dataType)).withColumn("event_type", F.lit("end"))
    ev.coalesce(1).write.parquet(f"{src}")
    late.coalesce(1).write.mode("append").parquet(f"{src}")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = event_trend(stream, unit, watermark="0 seconds").writeStream.outputMode("append").format("parquet").option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = sorted(map(tuple, rolled_up(spark.read.parquet(out)).filter("label <> 'end'").collect()))
    assert got == sorted(map(tuple, event_trend(ev, unit).collect()))


def test_event_trend_stream_equals_batch(spark, scratch):
    from topicscope.sources.tables import read_table
    from topicscope.streaming.trends import event_trend

    ev = read_table(spark, SF_SMALL, "events")
    src = os.path.join(scratch, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (
        event_trend(stream, "day", watermark="0 seconds")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("ev_trend")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("ev_trend").collect()))
    want = sorted(map(tuple, event_trend(ev, "day").collect()))
    assert got == want
