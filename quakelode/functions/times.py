"""Column expressions for instants, days and cycles. All of them are in UTC whatever the session's zone is."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakelode.constants import DAY


def utc(text: Column) -> Column:
    """Instant of an ISO string; one without an offset is in UTC; null where it is none."""
    t = F.trim(text)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z")))), F.try_to_timestamp(F.concat(F.when(F.length(t) == 10, t), F.lit("T00:00:00Z"))))


def epoch_seconds(time: Column) -> Column:
    """Whole seconds, towards the past."""
    return F.floor(F.unix_micros(time) / F.lit(1_000_000)).cast("long")


def epoch_days(time: Column) -> Column:
    """Days with their fraction."""
    return F.unix_micros(time) / F.lit(DAY * 1e6)


def date_seconds(date: Column) -> Column:
    """Epoch seconds of a date's midnight in UTC."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def day_of(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def cycles(seconds: Column) -> dict[str, Column]:
    """Days, hour, weekday (Monday 0), day of year and month, with the sine and cosine of each cycle."""
    date = day_of(seconds)
    parts = {"hour": (F.floor(F.pmod(seconds, F.lit(DAY)) / 3600).cast("int"), 24.0), "weekday": (F.weekday(date), 7.0), "day_of_year": (F.dayofyear(date), 365.25), "month": (F.month(date), 12.0)}
    out = {"unix_days": F.floor(seconds / DAY).cast("long")}
    for name, (value, period) in parts.items():
        angle = 2 * math.pi * value / period
        out |= {name: value, f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return out
