"""Live trend counts over an event stream.

Fixed-width buckets (minute, hour, day, and weeks from Monday) use a tumbling
event-time ``window``, so append mode emits each bucket once, after the
watermark has passed its end.  Calendar months, quarters and years are not
fixed-width: a stream emits their daily parts in the same way (rows of one
bucket add up), and ``rolled_up`` sums them on read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_bucket, resolution_unit

# window width and offset; the epoch was a Thursday
_FIXED = {"minute": ("1 minute", "0 seconds"), "hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}


def event_trend(
    events: DataFrame,
    resolution: str = "day",
    ts_col: str = "ts",
    label_col: str = "event_type",
    watermark: str = "1 day",
) -> DataFrame:
    """``label, date, articles`` counts per bucket, for a stream or a batch."""
    unit = resolution_unit(resolution)
    # watermarks need an instant (TIMESTAMP); wall-clock TIMESTAMP_NTZ is read
    # in the session time zone (UTC here)
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    ev = ev.withWatermark(ts_col, watermark) if events.isStreaming else ev
    if unit in _FIXED or events.isStreaming:
        width, offset = _FIXED.get(unit, _FIXED["day"])
        grouped = ev.groupBy(F.col(label_col).alias("label"), F.window(ts_col, width, None, offset).alias("w"))
        out = grouped.agg(F.count(F.lit(1)).alias("articles"))
        start = F.col("w.start")
        date = start if unit in ("minute", "hour") else calendar_bucket(start, unit)
        return out.select("label", date.alias("date"), "articles")
    # months and coarser, in a batch
    grouped = ev.groupBy(F.col(label_col).alias("label"), calendar_bucket(F.col(ts_col), unit).alias("date"))
    return grouped.agg(F.count(F.lit(1)).alias("articles"))


def rolled_up(trend: DataFrame) -> DataFrame:
    """The emitted parts of each bucket added up: ``label, date, articles``."""
    return trend.groupBy("label", "date").agg(F.sum("articles").alias("articles"))
