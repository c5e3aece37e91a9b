"""Time labels and differences. Two week systems are kept apart: ISO weeks and Monday-first weeks of the calendar year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(t) -> Column:
    """YYYY-Www by ISO 8601."""
    t = F.col(t) if isinstance(t, str) else t
    return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def calendar_week(t) -> Column:
    """YYYY-Www, weeks from Monday, 00 before the year's first Monday."""
    t = F.col(t) if isinstance(t, str) else t
    week = F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7)
    return F.concat(F.year(t).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def seconds(a, b) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def hours(a, b) -> Column:
    return seconds(a, b) / 3600.0


def days(a, b) -> Column:
    return seconds(a, b) / 86400.0


def quarter(t) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))


def quarter_index(t) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.year(t) * 4 + F.quarter(t) - 1
