"""Scalar rules: times of many formats, holidays, labels, weather and numeric helpers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comanda.functions.dates import business_date

#: The shop's own time zone; times without an offset are in it.
ZONE = "Asia/Kolkata"
_NAIVE = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
_OFFSET = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX][XX]"

#: Public holidays.
HOLIDAYS = (
    ("2025-01-26", "Republic Day 🇮🇳"), ("2025-02-26", "Maha Shivratri"), ("2025-03-14", "Holi"), ("2025-03-31", "Id-ul-Fitr (Eid)"), ("2025-04-10", "Mahavir Jayanti"), ("2025-04-14", "Dr. B. R. Ambedkar Jayanti"), ("2025-04-18", "Good Friday"), ("2025-05-12", "Buddha Purnima"),
    ("2025-06-07", "Id-ul-Zuha (Bakrid)"), ("2025-07-06", "Muharram"), ("2025-08-15", "Independence Day 🇮🇳"), ("2025-08-16", "Janmashtami"), ("2025-10-02", "Gandhi Jayanti 🇮🇳"), ("2025-10-20", "Diwali (Deepavali)"), ("2025-11-05", "Guru Nanak Jayanti"), ("2025-12-25", "Christmas"),
    ("2026-01-26", "Republic Day 🇮🇳"), ("2026-03-04", "Holi"), ("2026-03-21", "Id-ul-Fitr (Eid)"), ("2026-03-26", "Ram Navami"), ("2026-03-31", "Mahavir Jayanti"), ("2026-04-03", "Good Friday"), ("2026-05-01", "Buddha Purnima"), ("2026-05-27", "Id-ul-Zuha (Bakrid)"),
    ("2026-06-26", "Muharram"), ("2026-08-15", "Independence Day 🇮🇳"), ("2026-08-26", "Milad-un-Nabi / Id-e-Milad"), ("2026-09-04", "Janmashtami"), ("2026-10-02", "Gandhi Jayanti 🇮🇳"), ("2026-10-20", "Dussehra"), ("2026-11-08", "Diwali"), ("2026-11-24", "Guru Nanak Jayanti"), ("2026-12-25", "Christmas"),
)
#: Words of column names that are written in capitals.
CAPITALS = ("id", "api", "csv", "url", "sap", "gstin", "kpi")


def parsed_time(text: Column) -> Column:
    """The shop's local time of a text in any of the five accepted formats, else null."""
    offset = F.when(text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text, F.lit(_OFFSET)))
    local = F.convert_timezone(F.current_timezone(), F.lit(ZONE), offset.cast("timestamp_ntz"))
    naive = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _NAIVE]
    return F.coalesce(local, *naive)


def current_business_date(utc: Column) -> Column:
    """The open business day at a UTC time."""
    return business_date(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc.cast("timestamp_ntz")))


def last_complete_business_date(utc: Column) -> Column:
    return F.date_sub(current_business_date(utc), 1)


def holidays(spark: SparkSession) -> DataFrame:
    """day, holiday."""
    return spark.createDataFrame(list(HOLIDAYS), "day string, holiday string").select(F.col("day").cast("date").alias("day"), "holiday")


def indian_grouping(x: Column) -> Column:
    """A whole number with the last three digits and then pairs set apart; 0 for null."""
    s = F.coalesce(x.cast("long"), F.lit(0)).cast("string")
    head = F.regexp_replace(F.substr(s, F.lit(1), F.length(s) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(head, F.lit(","), F.right(s, F.lit(3))))


def hour_label(hour: Column) -> Column:
    h = hour.cast("int")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    return F.concat(twelve, F.when((h < 12) | (h == 24), " AM").otherwise(" PM"))


def rounded(x: Column, places: int) -> Column:
    """A double rounded as the binary number that it is, 76.615 to 76.61: ``F.round`` goes by the shortest
    decimal text, which lies half way more often."""
    return F.round(x * 10.0**places) / 10.0**places


def chart_label(x: Column) -> Column:
    """Rupees in thousands, lakhs and crores with one place."""
    step = lambda size, unit: F.concat(F.lit("₹"), rounded(x / size, 1).cast("string"), F.lit(unit))
    return F.when(x >= 10_000_000, step(10_000_000, "Cr")).when(x >= 100_000, step(100_000, "L")).when(x >= 1000, step(1000, "K")).otherwise(F.concat(F.lit("₹"), x.cast("string")))


def header_label(name: Column) -> Column:
    """Title case of a snake-case column name."""
    word = lambda w: F.when(F.lower(w).isin(*CAPITALS), F.upper(w)).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.split(name, "_"), word), " ")


def rain_category(mm: Column) -> Column:
    return F.when(mm >= 2.5, "heavy").when(mm >= 0.6, "drizzle").otherwise("none")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sine, cosine) of the place in a period."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def closeness(a: Column, b: Column) -> Column:
    """1 for equal numbers, 0 for far ones, by the larger of them."""
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))


def lognormal_moments(mean_log: Column, std_log: Column) -> tuple[Column, Column]:
    """(mean, standard deviation) on the scale of log1p's argument."""
    m, s = F.least(F.greatest(mean_log, F.lit(-50.0)), F.lit(50.0)), F.least(F.greatest(std_log, F.lit(0.0)), F.lit(5.0))
    spread = F.sqrt(F.greatest((F.exp(s * s) - 1) * F.exp(2 * m + s * s), F.lit(0.0)))
    return F.expm1(m + s * s / 2), spread


def number_of(text: Column) -> Column:
    """The finite number that a text holds, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_effectively_empty(rows: DataFrame) -> DataFrame:
    """One row: whether there is no row or no value in any row."""
    has = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rows.columns])
    return rows.agg((~F.coalesce(F.max(has), F.lit(False))).alias("is_empty"))


def named_weekday(day: Column, names: list[str]) -> Column:
    """Whether a calendar day is one of the weekdays, by English name."""
    return F.date_format(day, "EEEE").isin(*names)
