"""The registry of 25 analyses in six families.

An analysis maps a fact table to two lazy DataFrames: ``frame`` (the rows a chart would
show) and ``metrics`` (one row of plain numbers). Metrics are derived from the small
frame wherever they can be, so they never cost a second pass over the facts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.bins import capped_bin
from wayfare.functions.labels import label_by_code
from wayfare.functions.timeparts import minutes_between, month_name, weekday_name
from wayfare.operators.aggregates import group_by, peak, relabel, row_count, summary
from wayfare.operators.locations import hotspots, location_counts, top_locations, with_zone_label
from wayfare.roles import Roles


class Result(NamedTuple):
    frame: DataFrame | None
    metrics: DataFrame | None


class Analysis(NamedTuple):
    key: str
    family: str
    needs: tuple[str, ...]  # roles read: start, end, origin, ...
    run: Callable[..., Result]  # (df, roles) or, with labels, (df, roles, zones)
    labelled: bool = False

    def columns(self, roles: Roles) -> list[str]:
        return [getattr(roles, role) for role in self.needs]

    def __call__(self, df: DataFrame, roles: Roles, zones: DataFrame | None = None) -> Result:
        return self.run(df, roles, zones) if self.labelled else self.run(df, roles)


ANALYSES: dict[str, Analysis] = {}


def register(analysis: Analysis) -> None:
    if analysis.key in ANALYSES:
        raise ValueError(f"analysis {analysis.key!r} is already registered")
    ANALYSES[analysis.key] = analysis


def analysis(key: str, *needs: str, labelled: bool = False):
    """Register the decorated function under ``key``; its prefix names the family."""

    def add(run):
        register(Analysis(key, FAMILIES[key.split(".")[0]], needs, run, labelled))
        return run

    return add


# Family of each key prefix.
FAMILIES = {
    "demand": "Demand",
    "geo": "Geographic",
    "trip": "Trip",
    "rev": "Revenue",
    "pax": "Passenger",
    "air": "Airport",
}


def _total(column: str) -> Column:
    """Sum of a column, 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0))



def _duration(roles: Roles) -> Column:
    return minutes_between(roles.start, roles.end)


# Demand


@analysis("demand.by_hour", "start")
def trips_by_hour(df: DataFrame, roles: Roles) -> Result:
    frame = group_by(df, F.hour(roles.start), "hour", trips=row_count())
    return Result(frame, summary(frame, total_trips=_total("trips"), peak_hour=peak("hour", "trips")))


@analysis("demand.by_weekday", "start")
def trips_by_weekday(df: DataFrame, roles: Roles) -> Result:
    days = group_by(df, F.dayofweek(roles.start), "day", trips=row_count())
    metrics = summary(days, total_trips=_total("trips"), busiest_day=weekday_name(peak("day", "trips")))
    return Result(relabel(days, "day", weekday_name(F.col("day")), "weekday"), metrics)


@analysis("demand.by_month", "start")
def trips_by_month(df: DataFrame, roles: Roles) -> Result:
    months = group_by(df, F.month(roles.start), "m", trips=row_count())
    return Result(relabel(months, "m", month_name(F.col("m")), "month"), summary(months, total_trips=_total("trips")))


@analysis("demand.over_time", "start")
def trips_over_time(df: DataFrame, roles: Roles) -> Result:
    frame = group_by(df, F.to_date(roles.start), "period", trips=row_count())
    busiest = peak("period", "trips")
    covered = row_count()
    return Result(frame, summary(frame, total_trips=_total("trips"), days_covered=covered, busiest_day=busiest))


# Geographic


def _top_zones(df: DataFrame, roles: Roles, zones: DataFrame, location: str, k: int) -> Result:
    """Distinct zones count sentinel and NULL ids too, although the ranking leaves them out."""
    counts = location_counts(df, location)
    ranked = with_zone_label(top_locations(counts, roles, k), zones, "location_id")
    frame = ranked.orderBy(F.desc("trips"), "location_id").select("zone", "trips")
    known = ~F.col("location_id").isin(*roles.unknowns)
    first = F.min_by(
        F.when(known, F.col("location_id")),
        F.when(known, F.struct(-F.col("trips"), F.col("location_id"))),
    )
    top = summary(counts, distinct_zones=row_count(), location_id=first)
    metrics = with_zone_label(top, zones, "location_id", out="top_zone")
    return Result(frame, metrics.select("distinct_zones", "top_zone"))


@analysis("geo.top_pickups", "origin", labelled=True)
def top_pickups(df: DataFrame, roles: Roles, zones: DataFrame, k: int = 12) -> Result:
    return _top_zones(df, roles, zones, roles.origin, k)


@analysis("geo.top_dropoffs", "dest", labelled=True)
def top_dropoffs(df: DataFrame, roles: Roles, zones: DataFrame, k: int = 12) -> Result:
    return _top_zones(df, roles, zones, roles.dest, k)


@analysis("geo.hotspot_compare", "origin", "dest", labelled=True)
def hotspot_compare(df: DataFrame, roles: Roles, zones: DataFrame, k: int = 10) -> Result:
    frame = hotspots(df, roles, zones, k)
    return Result(frame, summary(frame, zones_compared=row_count()))


# Trip


@analysis("trip.distance_dist", "distance")
def distance_distribution(df: DataFrame, roles: Roles) -> Result:
    distance = F.col(roles.distance)
    plausible = df.filter((distance > 0) & (distance < 100))
    frame = group_by(plausible, capped_bin(distance, 1, 30), "bin", count=row_count())
    return Result(frame, summary(df, avg_distance=F.avg(distance)))


@analysis("trip.duration_dist", "start", "end")
def duration_distribution(df: DataFrame, roles: Roles) -> Result:
    timed = df.select(_duration(roles).alias("minutes"))
    minutes = F.col("minutes")
    plausible = timed.filter((minutes > 0) & (minutes <= 120))
    frame = group_by(plausible, capped_bin(minutes, 2, 60), "bin", count=row_count())
    return Result(frame, summary(timed, avg_duration_min=F.avg(minutes)))


@analysis("trip.avg_duration", "start", "end")
def average_duration(df: DataFrame, roles: Roles) -> Result:
    return Result(None, summary(df, avg_duration_min=F.avg(_duration(roles))))


@analysis("trip.avg_distance", "distance")
def average_distance(df: DataFrame, roles: Roles) -> Result:
    return Result(None, summary(df, avg_distance=F.avg(roles.distance)))


@analysis("trip.avg_speed", "start", "end", "distance")
def average_speed(df: DataFrame, roles: Roles) -> Result:
    """Mean of the rows' own speeds, over rows that took any time."""
    hours = _duration(roles) / F.lit(60.0)
    speed = F.when(hours > 0, F.col(roles.distance) / hours)
    return Result(None, summary(df, avg_speed=F.avg(speed)))


# Revenue


@analysis("rev.total", "total")
def total_revenue(df: DataFrame, roles: Roles) -> Result:
    revenue = F.coalesce(F.sum(roles.total), F.lit(0.0))
    per_trip = revenue / F.greatest(row_count(), F.lit(1))
    return Result(None, summary(df, total_revenue=revenue, revenue_per_trip=per_trip))


@analysis("rev.by_hour", "start", "total")
def revenue_by_hour(df: DataFrame, roles: Roles) -> Result:
    frame = group_by(df, F.hour(roles.start), "hour", revenue=F.sum(roles.total))
    return Result(frame, summary(frame, total_revenue=_total("revenue")))


@analysis("rev.by_weekday", "start", "total")
def revenue_by_weekday(df: DataFrame, roles: Roles) -> Result:
    days = group_by(df, F.dayofweek(roles.start), "day", revenue=F.sum(roles.total))
    frame = relabel(days, "day", weekday_name(F.col("day")), "weekday")
    return Result(frame, summary(days, total_revenue=_total("revenue")))


@analysis("rev.by_month", "start", "total")
def revenue_by_month(df: DataFrame, roles: Roles) -> Result:
    months = group_by(df, F.month(roles.start), "m", revenue=F.sum(roles.total))
    frame = relabel(months, "m", month_name(F.col("m")), "month")
    return Result(frame, summary(months, total_revenue=_total("revenue")))


@analysis("rev.avg_fare", "fare")
def average_fare(df: DataFrame, roles: Roles) -> Result:
    return Result(None, summary(df, avg_fare=F.avg(roles.fare)))


@analysis("rev.avg_tip", "fare", "tip")
def average_tip(df: DataFrame, roles: Roles) -> Result:
    """Mean tip, and the mean of each row's tip as a percentage of its positive fare."""
    fare, tip = F.col(roles.fare), F.col(roles.tip)
    share = F.avg(F.when(fare > 0, tip / fare)) * 100.0
    return Result(None, summary(df, avg_tip=F.avg(tip), avg_tip_pct=share))


# Passenger


def _by_party(df: DataFrame, roles: Roles, **measures: Column) -> DataFrame:
    """Groups of up to six; zero and negative counts stay visible."""
    party = F.col(roles.party)
    return group_by(df.filter(party <= 6), party.cast("int"), "passenger_count", **measures)


@analysis("pax.distribution", "party")
def party_distribution(df: DataFrame, roles: Roles) -> Result:
    metrics = summary(df, avg_passengers=F.avg(roles.party))
    return Result(_by_party(df, roles, trips=row_count()), metrics)


@analysis("pax.avg_fare", "party", "fare")
def fare_by_party(df: DataFrame, roles: Roles) -> Result:
    return Result(_by_party(df, roles, avg_fare=F.avg(roles.fare)), None)


@analysis("pax.avg_distance", "party", "distance")
def distance_by_party(df: DataFrame, roles: Roles) -> Result:
    return Result(_by_party(df, roles, avg_distance=F.avg(roles.distance)), None)


# Airport


def _code(location: Column, roles: Roles) -> Column:
    return label_by_code(location, roles.specials, location.cast("string"))


def _special_side(df: DataFrame, roles: Roles, location: str) -> Result:
    at_special = df.filter(roles.is_special(location))
    frame = group_by(at_special, _code(F.col(location), roles), "airport", trips=row_count())
    return Result(frame, summary(frame, total_airport_trips=_total("trips")))


@analysis("air.pickups", "origin")
def special_pickups(df: DataFrame, roles: Roles) -> Result:
    return _special_side(df, roles, roles.origin)


@analysis("air.dropoffs", "dest")
def special_dropoffs(df: DataFrame, roles: Roles) -> Result:
    return _special_side(df, roles, roles.dest)


@analysis("air.revenue", "origin", "dest", "total")
def special_revenue(df: DataFrame, roles: Roles) -> Result:
    """A trip between two airports is credited to its origin only."""
    origin, dest = F.col(roles.origin), F.col(roles.dest)
    credited = F.when(roles.is_special(roles.origin), origin).otherwise(dest)
    touching = df.filter(roles.touches_special())
    frame = group_by(touching, _code(credited, roles), "airport", revenue=F.sum(roles.total))
    return Result(frame, summary(frame, total_airport_revenue=_total("revenue")))


@analysis("air.trends", "start", "origin", "dest")
def special_trends(df: DataFrame, roles: Roles) -> Result:
    touching = df.filter(roles.touches_special())
    frame = group_by(touching, F.to_date(roles.start), "period", trips=row_count())
    return Result(frame, summary(frame, total_airport_trips=_total("trips")))
