"""Dates of listings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup_month(*dates: Column) -> Column:
    """First of the month before that of the first known date."""
    return F.add_months(F.trunc(F.coalesce(*dates), "MM"), -1)


def months_since(d: Column, year: int = 2020) -> Column:
    return (F.year(d) - year) * 12 + F.month(d) - 1


def date10(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, 10)


def utc_naive(x: Column) -> Column:
    """A timestamp without a zone: the UTC time of a text or timestamp with one; a text without one is taken as it is; dirty text is null."""
    kept = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(x.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    zoned = F.trim(x.cast("string")).rlike("(?i)(z|utc|[+-]\\d{2}(:?\\d{2})?)$") & F.trim(x.cast("string")).rlike("\\d:\\d")
    return F.when(zoned, kept).otherwise(x.try_cast("timestamp_ntz"))


def cyclic(d: Column) -> dict[str, Column]:
    """Month, quarter, weekday (Monday 0), weekend, and month and weekday on the circle."""
    m, w = F.month(d), F.weekday(d)
    turn = lambda x, n: (F.sin(2 * math.pi * x / n), F.cos(2 * math.pi * x / n))
    (ms, mc), (ws, wc) = turn(m, 12), turn(w, 7)
    return {"month": m, "quarter": F.quarter(d), "weekday": w, "weekend": F.when(w >= 5, 1).otherwise(0), "month_sin": ms, "month_cos": mc, "weekday_sin": ws, "weekday_cos": wc}
