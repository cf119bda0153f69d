"""Row-wise features: calendar, cyclic, regime flags and log distance.

Stateless, so the same function serves a batch and a streaming DataFrame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.cleaning import with_derived
from wayfare.roles import Roles

# Weekday rush hours, both ends inclusive.
RUSH_MORNING = (7, 9)
RUSH_EVENING = (16, 19)

CALENDAR = ["pickup_hour", "pickup_dayofweek", "pickup_month"]
FLAGS = ["is_weekend", "is_rush_hour", "is_airport"]
CYCLIC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]


def _circle(position: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * position / F.lit(period)
    return F.sin(angle), F.cos(angle)


def basic_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Add every feature that needs only the row itself."""
    hour, weekday = F.hour(roles.start), F.dayofweek(roles.start)
    weekend = weekday.isin(1, 7)
    rush = ~weekend & (hour.between(*RUSH_MORNING) | hour.between(*RUSH_EVENING))
    hour_sin, hour_cos = _circle(hour, 24)
    dow_sin, dow_cos = _circle(weekday - 1, 7)
    return with_derived(df, roles).withColumns(
        {
            "pickup_hour": hour,
            "pickup_dayofweek": weekday,
            "pickup_month": F.month(roles.start),
            "is_weekend": weekend.cast("int"),
            "is_rush_hour": rush.cast("int"),
            "is_airport": roles.touches_special().cast("int"),
            "log_distance": F.log1p(roles.distance),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
        }
    )


def model_features(roles: Roles) -> list[str]:
    """The 16 features a single row can supply; models train on these."""
    raw = [roles.distance, roles.party, roles.rate_code, roles.origin, roles.dest]
    return [*raw, *CALENDAR, *FLAGS, "log_distance", *CYCLIC]


def raw_features(roles: Roles) -> list[str]:
    return [roles.distance, roles.party, roles.rate_code, roles.origin, roles.dest]
