import os
import shutil

from .conftest import SF_SMALL
from .test_sources import FIXTURE


def test_train_with_cache_and_listing(spark, scratch):
    from topicscope.plans.lifecycle import models_with_predictions, remove_model, train, training_sample
    from topicscope.sources.tables import articles_view

    arts = articles_view(spark, SF_SMALL).drop("label")
    cache = os.path.join(scratch, "sample_forward_50")
    s1 = training_sample(spark, arts, 50, "forward", cache_path=cache)
    assert [r["pos"] for r in s1.orderBy("pos").collect()] == list(range(50))
    s2 = training_sample(spark, arts, 50, "forward", cache_path=cache)
    assert sorted(map(tuple, s1.collect())) == sorted(map(tuple, s2.collect()))
    uni = training_sample(spark, arts, 30, "uniform", seed=7)
    assert uni.count() == 30
    models = os.path.join(scratch, "models")
    m = train(spark, arts, os.path.join(models, "m1"), n_samples=80, method="uniform", seed=3,
              min_df=0.02, max_df=0.5, n_components=5, n_clusters=3, random_state=1)
    assert m.names.count() == 3
    os.makedirs(os.path.join(models, "m2"))
    spark.sql("DROP TABLE IF EXISTS src_m1_predictions")
    spark.createDataFrame([(1, 0)], "pmid long, label int").write.saveAsTable("src_m1_predictions")
    assert [r["model"] for r in models_with_predictions(spark, models, "src").collect()] == ["m1"]
    assert remove_model(spark, os.path.join(models, "m1"), "m1") == ["src_m1_predictions"]
    assert models_with_predictions(spark, models, "src").count() == 0


def test_extract_skips_existing(spark, scratch):
    from topicscope.plans.lifecycle import extract_to_json

    src = os.path.join(scratch, "xml")
    os.makedirs(src)
    shutil.copy(FIXTURE, os.path.join(src, "a.xml"))
    out = os.path.join(scratch, "json")
    assert extract_to_json(spark, src, out) == ["a"]
    shutil.copy(FIXTURE, os.path.join(src, "b.xml"))
    assert extract_to_json(spark, src, out) == ["b"]
    assert extract_to_json(spark, src, out) == []
    assert extract_to_json(spark, src, out, overwrite=True) == ["a", "b"]
    assert spark.read.json(out).filter("PMID IS NOT NULL").count() == 8
