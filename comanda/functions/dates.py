"""Business days (05:00 to 05:00), weeks and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPENING = "INTERVAL 5 HOURS"


def business_date(ts: Column) -> Column:
    return F.to_date(ts - F.expr(OPENING))


def day_range(ts: Column, start: str, end: str) -> Column:
    """Half-open range of business days start..end; sargable, so it reaches the scan."""
    lo, hi = (F.lit(d).cast("date").cast("timestamp_ntz") + F.expr(OPENING) for d in (start, end))
    return (ts >= lo) & (ts < hi + F.expr("INTERVAL 1 DAY"))


def sunday_first(day: Column) -> Column:
    """Weekday with Sunday 0."""
    return F.dayofweek(day) - 1


def week_of_year(day: Column) -> Column:
    """Monday-first week 00..53, as C's %W."""
    return F.lpad(F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string"), 2, "0")


def week_ending_sunday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "Sun")


def text_date(day: Column) -> Column:
    return day.cast("string")


def percent(part: Column, whole: Column) -> Column:
    """Half-up to two places; 0 where the whole is 0."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, 2))


def money(total: Column) -> Column:
    """Sums compared between engines: two places, 0 for no rows."""
    return F.round(F.coalesce(total, F.lit(0.0)), 2)
