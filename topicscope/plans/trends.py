"""Trend queries: nearest topics for a query, their spike-filtered, gap-filled
trends merged on date, names and plot series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import resolution_unit
from ..functions.vectors import DISTANCES
from ..operators import trends as TR
from ..operators import vectors as V


def closest_labels(centres: DataFrame, query: Sequence[float], closest_n: int, distance: str) -> list[int]:
    """The ``closest_n`` labels nearest to ``query``.

    This is the one driver round trip of the query, and it returns at most
    ``closest_n`` integers.  Having them as literals lets the label filter on
    the (possibly label-partitioned) prediction table prune partitions and push
    down to the scan.
    """
    if distance not in DISTANCES:
        raise ValueError(f"Invalid distance: {distance}")
    rows = V.nearest_topics(centres, query, closest_n, distance).select("label").collect()
    return [int(r["label"]) for r in rows]


def trends_for_vector(
    centres: DataFrame,
    query: Sequence[float],
    articles: DataFrame,
    predictions: DataFrame,
    resolution: str = "month",
    distance: str = "cosine",
    closest_n: int = 1,
    ignore_top_n_dates: int = 0,
) -> DataFrame:
    """``date, label, articles`` for the topics nearest to ``query``."""
    resolution_unit(resolution)
    labels = closest_labels(centres, query, closest_n, distance)
    return TR.spike_filtered_trend(articles, predictions, resolution, labels, ignore_top_n_dates)


def figure(trend: DataFrame, names: DataFrame) -> DataFrame:
    """Plot series: ``label, name, type, x, y`` (the ``[]`` result of an empty
    query is an empty DataFrame)."""
    return TR.trend_series(TR.name_trends(trend, names))


def pivot_wide(trend: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Wide form ``date, count_<label>...`` (only for display, at the edge)."""
    wide = trend.groupBy("date").pivot("label", [int(x) for x in labels]).agg(F.first("articles"))
    for lab in labels:
        wide = wide.withColumnRenamed(str(int(lab)), f"count_{int(lab)}")
    return wide.na.fill(0).orderBy("date")


def generate_figure(
    model,
    query: str,
    resolution: str,
    articles: DataFrame,
    predictions_table: str,
    distance: str = "cosine",
    closest_n: int = 4,
    ignore_top_n_dates: int = 0,
) -> DataFrame:
    """Named plot series for a text query: empty without a query; a missing
    prediction table is an error."""
    spark = articles.sparkSession
    if not query:
        return spark.createDataFrame([], "label int, name string, type string, x array<date>, y array<bigint>")
    if not spark.catalog.tableExists(predictions_table):
        raise ValueError(f"Predictions table {predictions_table} does not exist")
    trend = model.generate_trends(
        query, resolution, articles, spark.table(predictions_table), distance, closest_n, ignore_top_n_dates
    )
    return figure(trend, model.names)
