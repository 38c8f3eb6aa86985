"""Dates and trends: completion offset, reconstructed dates, docs per day,
spike ranking and removal, calendar histograms per label, gap filling, the
outer merge of label trends, name lookup and plot series.

Shapes (long form throughout; pivot only at the edge):

* articles     pmid, article_date, date_completed, [date_revised], ...
* predictions  pmid, date, date_completed, label
* trend        label, date, articles
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_bucket, previous_bucket, reconstructed_date, resolution_unit, spine
from .common import bounded_broadcast

DATE_FIELDS = ("date_completed", "article_date", "date_revised")


def completion_offset(articles: DataFrame) -> DataFrame:
    """Mean days from article date to completion date, half-even rounded; 0 if
    no article has both dates.  One row, column ``offset_days`` (int)."""
    both = articles.filter(F.col("article_date").isNotNull() & F.col("date_completed").isNotNull())
    return both.agg(
        F.coalesce(F.bround(F.avg(F.datediff("date_completed", "article_date")), 0), F.lit(0.0))
        .cast("int")
        .alias("offset_days")
    )


def with_reconstructed_date(articles: DataFrame, offset: DataFrame | None = None) -> DataFrame:
    """Add ``date`` = article date, else completion date minus the offset.

    The offset is a scalar subquery: computed once by Spark, then used as a
    constant in the projection (no join, no driver round trip).
    """
    if offset is None:
        offset = completion_offset(articles)
    return articles.withColumn(
        "date", reconstructed_date("article_date", "date_completed", offset.scalar())
    )


def _zero_filled(counts: DataFrame, resolution: str, keys: list[str]) -> DataFrame:
    """``counts`` plus a zero for every bucket between the first and the last of
    each key: every bucket also writes the empty ones up to the next bucket of its key.
    One pass over the counts; the window holds one row per bucket."""
    nxt = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    reach = F.coalesce(previous_bucket(F.col("_next"), resolution), F.col("date"))
    run = counts.select(*keys, "date", "articles", nxt.alias("_next")).select(
        *keys, "articles", F.posexplode(spine(F.col("date"), reach, resolution)).alias("_i", "date")
    )
    return run.select(*keys, "date", F.when(F.col("_i") == 0, F.col("articles")).otherwise(F.lit(0)).cast("long").alias("articles"))


def day_counts(articles: DataFrame, date_field: str = "date_completed") -> DataFrame:
    """Articles per calendar day of ``date_field``: ``date, articles``, days without
    articles left out."""
    if date_field not in DATE_FIELDS:
        raise ValueError(f"Invalid date field: {date_field!r}; expected one of {DATE_FIELDS}")
    days = articles.select(F.col(date_field).cast("date").alias("date")).filter(F.col("date").isNotNull())
    return days.groupBy("date").agg(F.count(F.lit(1)).alias("articles"))


def docs_per_day(articles: DataFrame, date_field: str = "date_completed") -> DataFrame:
    """Articles per calendar day of ``date_field``, zero-filled between the first
    and the last day; rows without the date are not counted.  ``date, articles``."""
    return _zero_filled(day_counts(articles, date_field), "day", [])


def rank_days(per_day: DataFrame) -> DataFrame:
    """Rank days by article count, descending; ties in date order (rank 1 = biggest).

    The window has no partition key, but its input holds one row per calendar
    day (tens of thousands at most, whatever the corpus size).
    """
    w = Window.orderBy(F.desc("articles"), F.asc("date"))
    return per_day.withColumn("rank", F.row_number().over(w))


def top_spike_dates(per_day: DataFrame, n: int) -> DataFrame:
    """The ``n`` days with the most articles (``date``), ties in date order.

    ``orderBy().limit(n)`` plans as TakeOrderedAndProject: a top-n per
    partition, then a merge of ``n * partitions`` rows.
    """
    if n <= 0:
        return per_day.select("date").limit(0)
    return per_day.orderBy(F.desc("articles"), F.asc("date")).limit(n).select("date")


def drop_spike_dates(predictions: DataFrame, spike_dates: DataFrame, n_bound: int | None = None) -> DataFrame:
    """Drop rows whose ``date_completed`` is a spike date; NULL completion dates stay.

    A left-anti join keeps NULL keys (``NOT IN (subquery)`` would drop them).
    The spike list is bounded by the caller's ``n``, so it is broadcast.
    """
    spikes = bounded_broadcast(spike_dates.select(F.col("date").alias("_spike")), n_bound)
    return predictions.join(spikes, predictions["date_completed"] == spikes["_spike"], "left_anti")


def label_trend(predictions: DataFrame, resolution: str, labels: Sequence[int] | None = None) -> DataFrame:
    """Calendar histogram of ``date`` per label: ``label, date, articles``.

    One grouped aggregation for all labels at once (partial aggregation on the
    map side, so a label holding most rows still shuffles one row per bucket
    per task).  Rows without a date are not counted.
    """
    resolution_unit(resolution)
    rows = predictions.filter(F.col("date").isNotNull())
    if labels is not None:
        rows = rows.filter(F.col("label").isin([int(x) for x in labels]))
    return (
        rows.groupBy("label", calendar_bucket("date", resolution).alias("date"))
        .agg(F.count(F.lit(1)).alias("articles"))
    )


def gap_fill(trend: DataFrame, resolution: str) -> DataFrame:
    """Per label, add zero-count buckets between its first and last bucket."""
    return _zero_filled(trend, resolution, ["label"]).select("label", "date", "articles")


def trend_matrix(filled: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Outer merge of per-label gap-filled trends on ``date``, holes -> 0.

    Domain: the union of every chosen label's buckets; each chosen label gets a
    value on every date of the domain (a label without rows is all zeros).
    One pivot on ``date`` with the chosen labels given up front (no extra job
    to find them), then back to long form.
    """
    chosen = [int(x) for x in labels]
    if not chosen:
        return filled.select("date", "label", "articles").limit(0)
    wide = filled.filter(F.col("label").isin(chosen)).groupBy("date").pivot("label", chosen).agg(F.first("articles"))
    cells = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("articles")) for x in chosen])
    return wide.select("date", F.explode(cells).alias("c")).select(
        "date", F.col("c.label").alias("label"), F.coalesce(F.col("c.articles"), F.lit(0)).cast("long").alias("articles")
    )


def name_trends(trend: DataFrame, names: DataFrame, names_bound: int | None = None) -> DataFrame:
    """Attach topic names; a label without a name keeps a NULL name."""
    return trend.join(bounded_broadcast(names.select("label", "name"), names_bound), "label", "left")


def trend_series(named: DataFrame) -> DataFrame:
    """One plot series per label: ``label, name, type, x array<date>, y
    array<bigint>`` in date order (``type`` is the plot type, ``line``)."""
    grouped = named.groupBy("label", "name").agg(
        F.array_sort(F.collect_list(F.struct("date", "articles"))).alias("pts")
    )
    return grouped.select(
        "label",
        "name",
        F.lit("line").alias("type"),
        F.transform("pts", lambda p: p["date"]).alias("x"),
        F.transform("pts", lambda p: p["articles"]).alias("y"),
    )


def spike_filtered_trend(
    articles: DataFrame,
    predictions: DataFrame,
    resolution: str,
    labels: Sequence[int],
    ignore_top_n_dates: int = 0,
) -> DataFrame:
    """Trend for the chosen labels: spike days (ranked on ``articles`` by
    completion date) removed, histogram by reconstructed ``date``, gap filled
    per label, outer merged.  ``date, label, articles`` sorted by date."""
    preds = predictions.filter(F.col("label").isin([int(x) for x in labels]))
    if ignore_top_n_dates > 0:
        # days without articles cannot be spikes: no calendar is needed
        spikes = top_spike_dates(day_counts(articles, "date_completed"), ignore_top_n_dates)
        preds = drop_spike_dates(preds, spikes, ignore_top_n_dates)
    filled = gap_fill(label_trend(preds, resolution), resolution)
    return trend_matrix(filled, labels).orderBy("date", "label")
