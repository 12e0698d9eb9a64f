"""Zone-less date and time helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

When = dt.datetime | dt.date | str


def ts_lit(value: When) -> Column:
    """A ``timestamp_ntz`` literal; a bare date means its midnight."""
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")


def date_lit(value: When) -> Column:
    return ts_lit(value).cast("date")


def as_date(value: When) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.fromisoformat(value).date()


def plus_days(instant: Column, days: int | Column) -> Column:
    """Shift an instant by whole 24-hour days."""
    return instant + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour days, rounded towards minus infinity."""
    calendar_days = F.date_diff(F.to_date(end), F.to_date(start))
    overshoot = plus_days(start, calendar_days) > end
    return calendar_days - overshoot.cast("int")


def week_start(day: Column) -> Column:
    """Monday of the week of ``day``."""
    return F.trunc(day, "week")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")
