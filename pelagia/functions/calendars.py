"""Dates, positions and keys of the usual text formats as Column expressions. Unreadable values give null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def tenths(text) -> Column:
    """Degrees from tenths with a hemisphere letter: ``275N`` is 27.5, ``870W`` is -87.0."""
    text = F.upper(F.trim(_c(text)))
    value = F.expr("try_cast(null as double)") if text is None else F.regexp_extract(text, r"^(\d+)[NSEW]$", 1)
    number = F.when(value != "", value.cast("double") / 10)
    return F.when(F.substring(text, -1, 1).isin("S", "W"), -number).otherwise(number)


def number_or_zero(text) -> Column:
    """A number; empty and unreadable fields are 0."""
    return F.coalesce(F.trim(_c(text)).try_cast("double"), F.lit(0.0))


def hour_stamp(text) -> Column:
    """Timestamp (no zone) of ``yyyyMMddHH``."""
    t = F.trim(_c(text))
    fits = t.rlike(r"^\d{10}$")
    part = lambda a, n: F.substring(t, a, n)
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":00:00"))
    return F.when(fits, iso.try_cast("timestamp_ntz"))


def day_stamp(text) -> Column:
    """Date of ``yyyyMMdd``."""
    t = F.trim(_c(text))
    iso = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2))
    return F.when(t.rlike(r"^\d{8}$"), iso.try_cast("date"))


def calendar_360(seconds) -> Column:
    """``yyyymmdd`` of seconds since year 0 in a year of 12 months of 30 days; days and months count from 1."""
    days = F.floor(_c(seconds) / 86400).cast("long")
    year, in_year = F.floor(days / 360).cast("long"), F.pmod(days, F.lit(360))
    month, day = F.floor(in_year / 30).cast("long") + 1, F.pmod(in_year, F.lit(30)) + 1
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def date_and_seconds(date, seconds) -> Column:
    """Timestamp (no zone) of an integer date ``yyyymmdd`` and seconds of the day."""
    d = _c(date).cast("long")
    start = F.make_date((d / 10000).cast("int"), (F.floor(d / 100) % 100).cast("int"), (d % 100).cast("int"))
    return start.cast("timestamp_ntz") + F.make_dt_interval(secs=_c(seconds).cast("decimal(18,6)"))


def hour_of_month(ts) -> Column:
    """Index of an hourly slice in a file of a month: hour + 24 (day - 1)."""
    return F.hour(_c(ts)) + 24 * (F.dayofmonth(_c(ts)) - 1)


def request_key(name: str, *parts) -> Column:
    """Key of a cached request."""
    return F.sha1(F.concat_ws("|", F.lit(name), *[_c(p).cast("string") for p in parts]))
