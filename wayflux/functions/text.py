"""Column expressions for list text, dates and clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(text: Column) -> Column:
    """All runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1)


def split_list(text: Column) -> Column:
    """Items of ``"[a, b]"``, trimmed, without empty ones; null gives an empty array."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, "['\"]", ""))), lambda x: x != "")


def any_list(text: Column) -> Column:
    """JSON lists, quoted or bare lists, or text split at commas."""
    return F.coalesce(F.from_json(text, "array<string>"), split_list(text))


def date_of_yymmdd(value: Column) -> Column:
    return F.to_date(F.lpad(value.cast("string"), 6, "0"), "yyMMdd")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one time of day to a later one, across midnight if it is smaller."""
    return F.pmod(end - start, F.lit(86400))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * 6371.0)
