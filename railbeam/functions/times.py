"""Dates, times of day and epoch milliseconds.

Times of day are strings, ``HH:mm`` in the timetable and ``HH:mm:ss`` in the logs. Epoch values are
split by arithmetic, so the answers are UTC whatever the session time zone is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Weekday abbreviations used in the update feed's address.
_DAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def _two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def utc_date(epoch_ms: Column) -> Column:
    """The UTC date of epoch milliseconds."""
    days = (epoch_ms - F.pmod(epoch_ms, F.lit(DAY_MS))) / F.lit(DAY_MS)
    return F.date_add(F.lit(dt.date(1970, 1, 1)), days.cast("int"))


def utc_time(epoch_ms: Column) -> Column:
    """The UTC time of day of epoch milliseconds, ``HH:mm:ss``."""
    seconds = F.floor(F.pmod(epoch_ms, F.lit(DAY_MS)) / 1000)
    return F.concat(
        _two_digits(F.floor(seconds / 3600)),
        F.lit(":"),
        _two_digits(F.floor(seconds / 60) % 60),
        F.lit(":"),
        _two_digits(seconds % 60),
    )


def second_of_day(time: Column) -> Column:
    """Seconds since midnight of ``HH:mm`` or ``HH:mm:ss``."""
    parts = [F.substring(time, start, 2) for start in (1, 4, 7)]
    seconds = F.when(F.length(time) > 5, parts[2]).otherwise(F.lit("0"))
    return (
        parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + seconds.cast("int")
    ).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from one time of day to another, toward zero, no midnight wrap."""
    diff = second_of_day(end) - second_of_day(start)
    return F.when(diff < 0, -F.floor(-diff / 60)).otherwise(F.floor(diff / 60)).cast("bigint")


def whole_minutes(millis: Column) -> Column:
    """Milliseconds to minutes, toward zero."""
    return F.when(millis < 0, -F.floor(-millis / 60000)).otherwise(F.floor(millis / 60000)).cast("bigint")


def is_hhmm(value: Column) -> Column:
    return value.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$")


def hhmm_to_time(value: Column) -> Column:
    """``HHmm`` to ``HH:mm``; null when it is not a time."""
    return F.when(
        is_hhmm(value), F.concat_ws(":", F.substring(value, 1, 2), F.substring(value, 3, 2))
    )


def to_minute(time: Column) -> Column:
    """A time of day without its seconds."""
    return F.substring(time, 1, 5)


def iso_date(value: Column) -> Column:
    """``yyyy-MM-dd`` to a date; null when it is not one."""
    return F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value.try_cast("date"))


def iso_instant_date(value: Column) -> Column:
    """The UTC date of an ISO instant ending in ``Z``; null when it is not one."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?Z$"
    return F.when(value.rlike(shape), F.substring(value, 1, 10).try_cast("date"))


def short_date(date: Column) -> Column:
    """``dd/MM/yyyy``."""
    return F.date_format(date, "dd/MM/yyyy")


def yesterday_name(date: Column) -> Column:
    """Lower-case weekday of the day before."""
    names = F.array(*[F.lit(n) for n in _DAY_NAMES])
    return F.element_at(names, F.weekday(F.date_sub(date, 1)) + 1)


def yesterday_name_of(date: dt.date) -> str:
    """X18 for a job parameter."""
    return _DAY_NAMES[(date - dt.timedelta(days=1)).weekday()]
