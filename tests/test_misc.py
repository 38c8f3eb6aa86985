import os

import pytest

from .conftest import SF_SMALL


def test_table_lifecycle(spark, scratch):
    from topicscope.operators.store import drop_model_tables, drop_table, ensure_predictions_table, table_is_empty

    ensure_predictions_table(spark, "src_mx_predictions", os.path.join(scratch, "t1"))
    ensure_predictions_table(spark, "src_mx_predictions")  # exists: no error
    assert table_is_empty(spark, "src_mx_predictions")
    spark.sql("INSERT INTO src_mx_predictions VALUES (1, DATE'2020-01-01', NULL, 3)")
    assert not table_is_empty(spark, "src_mx_predictions")
    ensure_predictions_table(spark, "other_mx_predictions", os.path.join(scratch, "t2"))
    assert sorted(drop_model_tables(spark, "mx")) == ["other_mx_predictions", "src_mx_predictions"]
    drop_table(spark, "src_mx_predictions")  # missing: no error


def test_figure_guards(spark):
    from topicscope.plans.trends import generate_figure
    from topicscope.sources.tables import articles_view

    arts = articles_view(spark, SF_SMALL)
    assert generate_figure(None, "", "month", arts, "nope").count() == 0
    with pytest.raises(ValueError):
        generate_figure(object(), "query", "month", arts, "no_such_predictions")


def test_samples_match_a_plain_sort(spark):
    import hashlib

    from topicscope.operators import sampling as S
    from topicscope.sources.tables import read_table

    ids = read_table(spark, SF_SMALL, "documents").selectExpr("doc_id AS pmid")
    keys = sorted(r.pmid for r in ids.collect())
    drawn = set(sorted(keys, key=lambda k: (hashlib.md5(f"{k}:5".encode()).hexdigest(), k))[:37])
    rows = list(enumerate(keys))
    want = {"forward": rows[:37], "backward": rows[-37:], "uniform": [r for r in rows if r[1] in drawn]}
    assert {m: sorted(map(tuple, S.sample(ids, 37, m, "pmid", seed=5).collect())) for m in S.METHODS} == want
    with pytest.raises(ValueError):
        S.sample(ids, 10**6, "uniform", "pmid")
    assert S.sample(ids, 10**6, "backward", "pmid").count() == ids.count()


def test_sample_cache_key():
    from topicscope.plans.lifecycle import sample_cache_path

    a = sample_cache_path("/c", "pubmed", 100, "uniform", 1, {"include_title": True})
    b = sample_cache_path("/c", "pubmed", 100, "uniform", 2, {"include_title": True})
    assert a != b and "n=100" in a
