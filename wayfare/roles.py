"""Column roles and numeric limits shared by every operator.

The operators never hard-code a column name: a :class:`Roles` value says which
column of the fact table is the start time, the origin, the fare and so on, so
the same code runs on trips, orders or user events.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION = "duration_min"
START_DATE = "start_date"


@dataclass(frozen=True)
class Roles:
    """Which column plays which part, and which location ids are special."""

    start: str = "start_ts"
    end: str = "end_ts"
    origin: str = "origin_id"
    dest: str = "dest_id"
    distance: str = "distance"
    party: str = "party"
    rate_code: str = "rate_code"
    fare: str = "fare"
    tip: str = "tip"
    total: str = "total"
    specials: Mapping[int, str] = field(default_factory=dict)
    unknowns: tuple[int, ...] = ()

    def special_ids(self) -> list[int]:
        return sorted(self.specials)

    def is_special(self, location: str) -> Column:
        return F.col(location).isin(*self.special_ids())

    def touches_special(self) -> Column:
        return self.is_special(self.origin) | self.is_special(self.dest)

    def is_known(self, location: str) -> Column:
        """False for a sentinel id and NULL for a NULL id, so a filter drops both."""
        return ~F.col(location).isin(*self.unknowns)


@dataclass(frozen=True)
class Limits:
    """Plausibility limits of one record. The defaults are fixed values."""

    fare_min: float = 2.5
    fare_max: float = 250.0
    distance_min: float = 0.0
    distance_max: float = 100.0
    duration_min: float = 1.0
    duration_max: float = 180.0
    year_min: int = 2009
    year_max: int | None = None  # None: the calendar year after the query runs

    def year_ceiling(self) -> Column:
        if self.year_max is None:
            return F.year(F.current_date()) + 1
        return F.lit(self.year_max)


# Column names and location ids of the public TLC yellow-trip data.
TLC = Roles(
    start="tpep_pickup_datetime",
    end="tpep_dropoff_datetime",
    origin="PULocationID",
    dest="DOLocationID",
    distance="trip_distance",
    party="passenger_count",
    rate_code="RatecodeID",
    fare="fare_amount",
    tip="tip_amount",
    total="total_amount",
    specials={1: "EWR", 132: "JFK", 138: "LGA"},
    unknowns=(264, 265),
)
