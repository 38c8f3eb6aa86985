"""Property tests for the trend operators (hypothesis-generated predictions)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

DATES = st.one_of(st.none(), st.dates(min_value=dt.date(2019, 1, 1), max_value=dt.date(2021, 12, 31)))
ROWS = st.lists(st.tuples(st.integers(0, 3), DATES, DATES), min_size=1, max_size=40)


def _preds(spark, rows):
    data = [(i, d, c, lab) for i, (lab, d, c) in enumerate(rows)]
    return spark.createDataFrame(data, "pmid long, date date, date_completed date, label int")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, res=st.sampled_from(["day", "week", "month", "quarter", "year"]))
def test_trend_sums_and_gap_free(spark, rows, res):
    from topicscope.functions.dates import resolution_unit
    from topicscope.operators.trends import gap_fill, label_trend

    p = _preds(spark, rows)
    lt = label_trend(p, res)
    dated = [r for r in rows if r[1] is not None]
    # without spike removal the histogram counts every labelled row that has a date
    assert sum(r["articles"] for r in lt.collect()) == len(dated)
    filled = gap_fill(lt, res).collect()
    assert sum(r["articles"] for r in filled) == len(dated)
    unit = resolution_unit(res)
    by_label = {}
    for r in filled:
        by_label.setdefault(r["label"], []).append(r["date"])
    for dates in by_label.values():
        dates.sort()
        for a, b in zip(dates, dates[1:]):
            if unit == "day":
                assert (b - a).days == 1
            elif unit == "week":
                assert (b - a).days == 7
            else:
                months = (b.year - a.year) * 12 + b.month - a.month
                assert months == {"month": 1, "quarter": 3, "year": 12}[unit]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, n=st.integers(0, 4))
def test_spike_removal_keeps_null_completion_dates(spark, rows, n):
    from topicscope.operators.trends import docs_per_day, drop_spike_dates, top_spike_dates

    p = _preds(spark, rows)
    arts = p.select("pmid", "date_completed")
    spikes = {r["date"] for r in top_spike_dates(docs_per_day(arts), n).collect()}
    kept = {r["pmid"] for r in drop_spike_dates(p, top_spike_dates(docs_per_day(arts), n), n).collect()}
    for i, (_, _, c) in enumerate(rows):
        assert (i in kept) == (c is None or c not in spikes)


def test_rank_days_monotonic(spark):
    from topicscope.operators.trends import docs_per_day, rank_days
    from topicscope.sources.tables import order_articles

    from .conftest import SF_SMALL

    ranked = rank_days(docs_per_day(order_articles(spark, SF_SMALL))).orderBy("rank").collect()
    counts = [r["articles"] for r in ranked]
    assert counts == sorted(counts, reverse=True)
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))


def test_trend_matrix_zero_fills_chosen_labels(spark):
    from topicscope.operators.trends import gap_fill, label_trend, trend_matrix

    rows = [(0, dt.date(2020, 1, 5), None), (0, dt.date(2020, 3, 5), None), (1, dt.date(2020, 6, 1), None)]
    p = _preds(spark, rows)
    m = trend_matrix(gap_fill(label_trend(p, "month"), "month"), [0, 1, 2]).collect()
    got = {(r["date"], r["label"]): r["articles"] for r in m}
    months = {dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1), dt.date(2020, 6, 1)}
    assert {d for d, _ in got} == months
    assert all(got[(d, 2)] == 0 for d in months)
    assert got[(dt.date(2020, 2, 1), 0)] == 0 and got[(dt.date(2020, 6, 1), 0)] == 0
    assert got[(dt.date(2020, 6, 1), 1)] == 1


def test_bad_resolution_rejected():
    import pytest

    from topicscope.functions.dates import resolution_unit

    assert resolution_unit("M") == "month"
    with pytest.raises(ValueError):
        resolution_unit("fortnight")
