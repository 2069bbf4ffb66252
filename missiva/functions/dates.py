"""Column functions for dates and score classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_key(d: Column) -> Column:
    return F.date_format(d, "yyyy")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_key(d: Column) -> Column:
    """`YYYY-Qn`, or "unknown" for a missing date."""
    return F.coalesce(F.concat(year_key(d), F.lit("-Q"), F.quarter(d).cast("string")), F.lit("unknown"))


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Bad dates become NULL."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def period_split(d: Column, onset: str) -> Column:
    return F.when(d >= F.lit(onset).cast("date"), "post").when(d.isNotNull(), "pre")


def score_category(s: Column) -> Column:
    return F.when(s > 0.1, "positive").when(s < -0.05, "negative").otherwise("neutral")


def close_interval(start: Column, end: Column) -> Column:
    """A zero-length interval gets one extra day."""
    return F.when(end == start, F.date_add(end, 1)).otherwise(end)


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))
