"""Distributed selection, and the trend cube over increments."""

import random

import pytest
from pyspark.sql import functions as F

from topicscope.operators import sampling as S
from topicscope.operators import trends as TR
from topicscope.plans.trend_cube import TrendCube
from topicscope.sources.delta_store import PredictionStore


@pytest.mark.parametrize("method", S.METHODS)
@pytest.mark.parametrize("settled,bins", [(10_000, 4096), (0, 256)])
def test_selection_equals_a_sort(spark, monkeypatch, method, settled, bins):
    monkeypatch.setattr(S, "SETTLED", settled)
    monkeypatch.setattr(S, "BINS", bins)
    rng = random.Random(3)
    keys = rng.sample(range(-(10**12), 10**12), 150) + list(range(50)) + [7] * 5
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").repartition(4)
    order = {"forward": [F.col("k")], "backward": [F.desc("k")], "uniform": S.uniform_order("k", 5)}[method]
    want = [r["k"] for r in df.filter("k is not null").orderBy(*order).collect()]
    for n in (0, 1, 60, len(keys) - 1, len(keys), 1000):
        assert sorted(r["k"] for r in S.first_in_order(df, n, "k", method, 5).collect()) == sorted(want[:n])


def test_samples_sort_no_more_than_they_take(spark):
    df = spark.range(200_000).select(F.col("id").alias("pmid"))
    plan = S.first_in_order(df, 500, "pmid", "uniform", 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("TakeOrderedAndProject", "") and "TakeOrderedAndProject" in plan
    assert [r["pos"] for r in S.sample(df, 3, "backward").orderBy("pos").collect()] == [199_997, 199_998, 199_999]


def test_cube_follows_a_store(spark, scratch):
    rng = random.Random(6)
    day = lambda: None if rng.random() < 0.1 else f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}"
    rows = [(i, day(), "2020-03-03" if i % 4 == 0 else day(), rng.randrange(3)) for i in range(400)]
    cols = "pmid long, date string, date_completed string, label int"
    preds = spark.createDataFrame(rows, cols).withColumns({c: F.col(c).cast("date") for c in ("date", "date_completed")}).checkpoint()
    articles = preds.select("pmid", F.col("date").alias("article_date"), "date_completed")
    store, cube = PredictionStore(spark, "cube_follow_predictions", f"{scratch}/s", fan=3), TrendCube(spark, f"{scratch}/c")
    cube.add_articles(articles.filter("pmid < 250"), batch=("load", 0))
    cube.add_articles(articles.filter("pmid < 250"), batch=("load", 0))  # the same load again
    cube.add_articles(articles.filter("pmid >= 250"), batch=("load", 1))

    def same(table):
        for res, n in (("month", 0), ("week", 2)):
            want = TR.spike_filtered_trend(articles, table, res, [0, 2], n)
            assert sorted(map(tuple, cube.trend(res, [0, 2], n).collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, cube.docs_per_day().collect())) == sorted(map(tuple, TR.docs_per_day(articles).collect()))

    wrong = lambda df: df.withColumn("label", (F.col("label") + 1) % 3)
    store.append(wrong(preds.filter("pmid < 150")))
    assert cube.advance(store) == 1 and cube.advance(store) == 0
    same(store.read())
    store.append(preds.filter("pmid between 150 and 299"))
    store.upsert(preds.filter("pmid < 100"))
    store.append(preds.filter("pmid >= 300"))  # parts are merged here: nothing to count
    assert cube.advance(store) == len(store.versions()) - 1 > 3
    same(store.read())
    store.upsert(preds.filter("pmid < 150"))
    cube.advance(store)
    same(preds)
    plan = cube.trend("month", [0, 2], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmid" not in plan
    # a cube left behind a vacuum counts anew
    store.replace(wrong(preds))
    store.upsert(preds)
    store.compact()
    store.vacuum()
    cube.advance(store)
    same(preds)
    assert cube.version() == store.versions()[-1]
