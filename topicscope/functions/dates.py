"""Date column functions: assembling dates from parts, calendar buckets, spines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted resolution spellings -> calendar unit.  The unit names
# are the calendar intervals of a date histogram (day, week, month, quarter,
# year, plus hour and minute for timestamp streams); ``M`` is the default
# resolution the trend generator uses.
RESOLUTIONS = {
    "minute": "minute", "1m": "minute",
    "hour": "hour", "h": "hour", "1h": "hour",
    "day": "day", "d": "day", "1d": "day",
    "week": "week", "w": "week", "1w": "week",
    "month": "month", "M": "month", "1M": "month",
    "quarter": "quarter", "q": "quarter", "1q": "quarter",
    "year": "year", "y": "year", "1y": "year",
}

# Spine step per unit (Spark interval literal).
_STEP = {
    "minute": "INTERVAL 1 MINUTE",
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTHS",
    "year": "INTERVAL 1 YEAR",
}


def resolution_unit(resolution: str) -> str:
    """Canonical calendar unit for a resolution; unknown spellings raise.

    ``date_trunc('M', x)`` silently returns NULL in Spark, so every caller goes
    through this table instead of passing the user's string on.
    """
    try:
        return RESOLUTIONS[resolution]
    except KeyError:
        if isinstance(resolution, str) and resolution.lower() in RESOLUTIONS and resolution.lower() != "m":
            return RESOLUTIONS[resolution.lower()]
        raise ValueError(f"Invalid resolution: {resolution!r}; expected one of {sorted(set(RESOLUTIONS.values()))}") from None


def calendar_bucket(col: Column | str, resolution: str) -> Column:
    """Start of the calendar bucket holding ``col`` (weeks start on Monday).

    Day and coarser units come back as DATE, hour and minute as TIMESTAMP.
    """
    unit = resolution_unit(resolution)
    c = F.col(col) if isinstance(col, str) else col
    truncated = F.date_trunc(unit, c)
    if unit in ("minute", "hour"):
        return truncated
    return truncated.cast("date")


def spine(lo: Column, hi: Column, resolution: str) -> Column:
    """Every bucket start from ``lo`` to ``hi`` (both already bucket starts)."""
    unit = resolution_unit(resolution)
    return F.sequence(lo, hi, F.expr(_STEP[unit]))


def previous_bucket(start: Column, resolution: str) -> Column:
    """The bucket start one step before a bucket start."""
    return start - F.expr(_STEP[resolution_unit(resolution)])


def assemble_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date from Year/Month/Day text leaves; NULL when a part is missing or bad.

    ``try_to_date`` (not ``make_date``, which throws under ANSI mode) turns a
    month of 13, a month name or a missing day into NULL instead of failing the
    record.
    """
    y, m, d = (F.col(c) if isinstance(c, str) else c for c in (year, month, day))
    text = F.concat_ws(
        "-",
        F.trim(y),
        F.lpad(F.trim(m), 2, "0"),
        F.lpad(F.trim(d), 2, "0"),
    )
    return F.when(y.isNull() | m.isNull() | d.isNull(), F.lit(None).cast("date")).otherwise(
        F.try_to_date(text, "yyyy-MM-dd")
    )


def reconstructed_date(article_date: Column | str, date_completed: Column | str, offset_days: Column) -> Column:
    """Article date, else completion date minus the mean completion offset."""
    a = F.col(article_date) if isinstance(article_date, str) else article_date
    c = F.col(date_completed) if isinstance(date_completed, str) else date_completed
    return F.coalesce(a, F.date_sub(c, offset_days.cast("int")))
