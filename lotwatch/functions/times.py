"""Dates and times as expressions. Times are UTC; local ones name their zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the local zone of months and slots.
ZONE = "America/Montevideo"


def parse_utc(text: Column) -> Column:
    """An ISO 8601 time, UTC where it names no offset; null if it is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def parse_local(text: Column, zone: str = ZONE) -> Column:
    """An ISO 8601 time, local where it names no offset."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), parse_utc(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone))


def parse_any(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")) -> Column:
    """The first of these formats that fits, or seconds or milliseconds since 1970 between the years 2000 and 2200."""
    n = text.try_cast("double")
    s = F.when(n > 1e11, n / 1000).otherwise(n)
    epoch = F.when((s >= 946684800) & (s < 7258118400), F.timestamp_seconds(s))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], epoch)


def remaining_text(seconds: Column) -> Column:
    """2d 3h, 3h 5m, 5m, "cerrado" from 0 on down, "-" for null."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    text = (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), hours.cast("string"), F.lit("h")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )
    return F.when(s.isNull(), "-").when(s <= 0, "cerrado").otherwise(text)


def urgency(seconds: Column) -> Column:
    """0 closed, 1 within 6 hours, 2 within a day, 3 within three, 4 later, null unknown."""
    hour = 3600
    return F.when(seconds <= 0, 0).when(seconds <= 6 * hour, 1).when(seconds <= 24 * hour, 2).when(seconds <= 72 * hour, 3).when(seconds.isNotNull(), 4)


def month_start(at: Column, zone: str = ZONE) -> Column:
    """The UTC time at which the local month of `at` began."""
    return F.to_utc_timestamp(F.date_trunc("month", F.from_utc_timestamp(at, zone)), zone)


def local_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def age_days(seen: Column, today: Column) -> Column:
    return F.datediff(today, seen)


def is_stale(seen: Column, today: Column, days: int = 180) -> Column:
    """Older than so many days; unknown dates are stale."""
    return F.coalesce(age_days(seen, today) > days, F.lit(True))


def fresh(at: Column, now: Column, hours: int = 24) -> Column:
    """Is `at` no longer than so many hours before `now`?"""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) < hours * 3600, F.lit(False))
