"""Dates, zones and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 as int: what RANGE frames by days are ordered by."""
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def local_date(ts: Column, zone: str) -> Column:
    """The calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def utc_offset_hours(day: Column, zone: Column) -> Column:
    """The offset of a zone at noon of a day, daylight saving included."""
    noon = (day.cast("timestamp") + F.expr("INTERVAL 12 HOURS")).cast("timestamp")
    return (F.unix_timestamp(noon) - F.unix_timestamp(F.to_utc_timestamp(noon, zone))) / 3600.0


def season_of(day: Column, first_month: int = 7) -> Column:
    """The season's code YYYYZZZZ, first and second year; it begins with first_month."""
    y = F.year(day) - (F.month(day) < first_month).cast("int")
    return (y * 10000 + y + 1).cast("int")


def season_before(season: Column) -> Column:
    return (season - 10001).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def spans(low: Column, high: Column, days: int) -> Column:
    """array<struct<first, last>>: [low, high] cut into parts of at most so many days."""
    starts = F.sequence(low, high, F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(starts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), high).alias("last")))
