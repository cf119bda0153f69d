"""Per-location daily history that never sees the row's own day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.aggregates import row_count
from wayfare.roles import DURATION, START_DATE, Roles

PREVIOUS_DAY = "zone_prev_day_avg"
LAST_7 = "zone_7d_avg"
HISTORY = [PREVIOUS_DAY, LAST_7]


def zone_days(df: DataFrame, roles: Roles) -> DataFrame:
    """(origin, date, trips, day_avg): the only pass over the facts the history needs."""
    return df.groupBy(roles.origin, START_DATE).agg(
        row_count().alias("trips"), F.avg(DURATION).alias("day_avg")
    )


def zone_history(days: DataFrame, roles: Roles, calendar: bool = False) -> DataFrame:
    """Add the previous observed day's mean and the mean of the last seven day means.

    ``calendar=False`` looks back over seven *observed* days; ``calendar=True`` over the
    seven calendar days before, which differs where a location has idle days. A window
    partition holds one row per day of one location, however many facts that day has.
    """
    per_zone = Window.partitionBy(roles.origin)
    by_day = per_zone.orderBy(START_DATE)
    if calendar:
        past_week = per_zone.orderBy(F.unix_date(START_DATE)).rangeBetween(-7, -1)
    else:
        past_week = by_day.rowsBetween(-7, -1)
    return days.withColumns(
        {
            PREVIOUS_DAY: F.lag("day_avg", 1).over(by_day),
            LAST_7: F.avg("day_avg").over(past_week),
        }
    )


def join_history(df: DataFrame, history: DataFrame, roles: Roles) -> DataFrame:
    """Facts left-joined to their location-day history.

    The history side has one row per location and day, so the join cannot multiply rows.
    Where it is too large to broadcast, adaptive execution splits the partition of a hot
    location-day.
    """
    keys = [roles.origin, START_DATE]
    return df.join(history.select(*keys, *HISTORY), keys, "left")
