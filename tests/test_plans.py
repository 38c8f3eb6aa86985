"""Plan-shape checks: the properties that matter at scale, asserted on the
physical plans of registered queries."""

import re

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trend_prunes_partitions_and_broadcasts_bounded_spikes(spark):
    from topicscope.plans.registry import trend_matrix

    p = _plan(trend_matrix(spark, SF_SMALL))
    # the chosen labels prune the label-partitioned prediction table
    assert re.search(r"PartitionFilters: \[[^\]]*label[^\]]*\]", p)
    assert "TakeOrderedAndProject" in p
    assert "BroadcastHashJoin" in p and "LeftAnti" in p
    # only the columns the trend needs are read from the prediction table
    assert "ReadSchema: struct<date:date,date_completed:date>" in p


def test_label_trend_is_partially_aggregated(spark):
    from topicscope.plans.registry import QUERIES

    p = _plan(QUERIES["label_trend_month"](spark, SF_SMALL))
    assert "partial_count" in p


def test_centre_distances_use_no_join(spark):
    from topicscope.plans.registry import assign_nearest

    p = _plan(assign_nearest(spark, SF_SMALL))
    assert "Join" not in p.split("Subquery")[0]


def test_upsert_has_no_window(spark):
    from topicscope.plans.registry import upsert_latest

    p = _plan(upsert_latest(spark, SF_SMALL))
    assert "Window" not in p and "partial_max" in p


def test_tfidf_document_frequency_is_partially_aggregated(spark):
    from topicscope.plans.registry import tfidf

    p = _plan(tfidf(spark, SF_SMALL))
    assert "partial_count" in p
    assert "Window [sum" in p  # per-document norm, not a join back


def test_trends_read_each_table_once(spark):
    from topicscope.plans.registry import QUERIES

    for name, scans in (("gap_filled_trend", 1), ("docs_per_day", 1), ("trends_for_query", 2)):
        df = QUERIES[name](spark, SF_SMALL)
        df.collect()
        assert _plan(df).split("Initial Plan")[0].count("FileScan") == scans, name


def test_term_counts_shuffle_texts_and_not_terms(spark):
    from topicscope.operators import features as FE

    docs = spark.createDataFrame([(i % 5, f"aa bb cc aa {i}") for i in range(10)], "doc_id long, text string").repartition(3)
    tf = FE.term_counts(docs, ngram_range=(1, 2))
    plan = tf._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "term" not in dealt[0]
    rows = {(r.doc_id, r.term): r.tf for r in tf.collect()}
    assert rows[0, "aa"] == 4 and rows[0, "aa bb"] == 2 and (0, "aa aa") not in rows  # documents of two rows are counted together


def test_embeddings_are_reduced_without_a_join(spark):
    from topicscope.plans.embedding_topics import EmbeddingTopicModel

    m = EmbeddingTopicModel(n_components=2)
    m.components, m._d, m._k = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [3.0, 0.0])], "idx int, v array<double>"), 3, 2
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [2.0, float("nan")]), (4, [1.0, None, 0.0, 9.0]), (5, [])]
    out = m._reduce(spark.createDataFrame(rows, "doc_id long, embedding array<double>"))
    assert "Join" not in _plan(out) and "Exchange" not in _plan(out)
    assert {r.doc_id: r.vector for r in out.collect()} == {1: [11.0, 0.0], 2: [0.0, 0.0], 3: [2.0, 4.0], 4: [1.0, 2.0], 5: [0.0, 0.0]}
