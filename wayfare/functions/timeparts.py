"""Calendar and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in calendar order; weekday 1 is Sunday.
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def minutes_between(start: str, end: str) -> Column:
    """Minutes from start to end; sub-second parts are cut before subtracting."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60.0)


def label_from(names: tuple[str, ...], position: Column) -> Column:
    """The ``position``-th name (1-based); NULL for a NULL position."""
    return F.element_at(F.array(*map(F.lit, names)), position)


def weekday_name(day_of_week: Column) -> Column:
    return label_from(WEEKDAYS, day_of_week)


def month_name(month: Column) -> Column:
    return label_from(MONTHS, month)


def month_start(ts: str) -> Column:
    return F.trunc(F.to_date(ts), "month")
