"""Feature building: row features, location history, time split, train-only fill."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.labels import label_by_code
from wayfare.functions.timeparts import month_start, weekday_name
from wayfare.operators.aggregates import group_by, row_count
from wayfare.operators.cleaning import with_derived
from wayfare.operators.features import CALENDAR, CYCLIC, FLAGS, basic_features
from wayfare.operators.history import HISTORY, join_history, zone_days, zone_history
from wayfare.operators.split import fill_with, is_test, is_train, part_of, split_at, split_date
from wayfare.roles import DURATION, START_DATE, Roles
from wayfare.sources.sinks import stored, write_partitioned

# Fixed value: share of the rows held out as the future.
TEST_FRACTION = 0.2


def feature_columns(roles: Roles) -> list[str]:
    """All 18 features, location history included."""
    raw = [roles.distance, "log_distance", roles.party, roles.rate_code, roles.origin, roles.dest]
    return [*raw, *CALENDAR, *FLAGS, *CYCLIC, *HISTORY]


def target_columns(roles: Roles) -> list[str]:
    return [roles.fare, DURATION]


def processed_columns(roles: Roles) -> list[str]:
    """What the processed train and test tables keep."""
    return [*feature_columns(roles), *target_columns(roles), START_DATE]


def stored_history(rows: DataFrame, roles: Roles, calendar: bool = False) -> DataFrame:
    """The (location, day) history, computed now and kept as a small table.

    Joining it lazily would plan a shuffle of all facts, since Spark cannot foresee how
    small the aggregate is; its stored size decides between broadcast and shuffle.
    """
    return stored(zone_history(zone_days(rows, roles), roles, calendar), "zone-history")


def engineer(df: DataFrame, roles: Roles, calendar: bool = False) -> DataFrame:
    """Row features plus the location's past days."""
    rows = basic_features(df, roles)
    return join_history(rows, stored_history(rows, roles, calendar), roles)


class Features(NamedTuple):
    train: DataFrame
    test: DataFrame
    report: DataFrame


def build_features(df: DataFrame, roles: Roles, test_fraction: float = TEST_FRACTION) -> Features:
    """Train and test sets with filled history, and a one-row report.

    The cutoff, the fill means and both row counts are computed from the stored
    (location, day) table: the mean history over training rows equals the day values
    weighted by each day's rows. The facts are therefore aggregated once and joined once,
    rather than rescanned for every statistic.
    """
    rows = basic_features(df, roles)
    history = stored_history(rows, roles)
    cutoff = split_date(_days(history), test_fraction)
    means = _train_means(history, cutoff, roles)
    train, test = split_at(join_history(rows, history, roles), cutoff.scalar())
    return Features(
        fill_with(train, means, HISTORY),
        fill_with(test, means, HISTORY),
        _report(history, cutoff, means, roles, test_fraction),
    )


def write_processed(df: DataFrame, roles: Roles, path: str, test_fraction: float = TEST_FRACTION) -> None:
    """Write :func:`processed_columns` of both parts, by part and month, in one job; undated rows are on neither side."""
    rows = basic_features(df, roles)
    history = stored_history(rows, roles)
    cutoff = split_date(_days(history), test_fraction)
    means = _train_means(history, cutoff, roles)
    cut = cutoff.scalar()
    joined = join_history(rows, history, roles).withColumn("part", part_of(is_train(cut), is_test(cut)))
    dated = joined.filter(F.col(START_DATE).isNotNull())
    filled = fill_with(dated, means, HISTORY).withColumn("month", month_start(START_DATE))
    write_partitioned(filled.select(*processed_columns(roles), "part", "month"), path, "part", "month")


def _days(history: DataFrame) -> DataFrame:
    return history.groupBy(START_DATE).agg(F.sum("trips").alias("trips"))


def _train_means(history: DataFrame, cutoff: DataFrame, roles: Roles) -> DataFrame:
    """Row-weighted training means of the history; a NULL location never gets history."""
    past = history.filter(is_train(cutoff.scalar()) & F.col(roles.origin).isNotNull())
    return past.agg(
        *[
            F.coalesce(
                F.sum(F.col(c) * F.col("trips")) / F.sum(F.when(F.col(c).isNotNull(), F.col("trips"))),
                F.lit(0.0),
            ).alias(c)
            for c in HISTORY
        ]
    )


def _report(
    history: DataFrame, cutoff: DataFrame, means: DataFrame, roles: Roles, test_fraction: float
) -> DataFrame:
    cut = cutoff.scalar()
    counted = _days(history).agg(
        F.coalesce(F.sum(F.when(is_train(cut), F.col("trips"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(is_test(cut), F.col("trips"))), F.lit(0)).alias("n_test"),
        F.coalesce(F.sum(F.when(F.col(START_DATE).isNull(), F.col("trips"))), F.lit(0)).alias("n_undated"),
    )
    fills = means.select(F.struct(*HISTORY)).scalar()
    return counted.select(
        "n_train",
        "n_test",
        "n_undated",
        cut.alias("split_date"),
        F.lit(test_fraction).alias("test_fraction"),
        F.lit(len(feature_columns(roles))).alias("n_features"),
        *[fills.getField(c).alias(f"fill_{c}") for c in HISTORY],
    )


# Aggregates showing the signal each engineered feature carries


def signal_by_hour(df: DataFrame, roles: Roles) -> DataFrame:
    return group_by(
        with_derived(df, roles),
        F.hour(roles.start),
        "pickup_hour",
        trips=row_count(),
        avg_fare=F.avg(roles.fare),
        avg_duration=F.avg(DURATION),
    )


def signal_by_weekday(df: DataFrame, roles: Roles) -> DataFrame:
    rows = with_derived(df, roles)
    days = group_by(rows, F.dayofweek(roles.start), "dow", trips=row_count(), avg_duration=F.avg(DURATION))
    return days.withColumn("weekday", weekday_name(F.col("dow")))


def signal_airport(df: DataFrame, roles: Roles) -> DataFrame:
    flag = roles.touches_special().cast("int")
    groups = group_by(
        df,
        flag,
        "is_airport",
        avg_fare=F.avg(roles.fare),
        avg_distance=F.avg(roles.distance),
        trips=row_count(),
    )
    label = label_by_code(F.col("is_airport"), {0: "Non-airport", 1: "Airport"}, F.lit(None))
    return groups.withColumn("group", label)


def daily_trip_series(df: DataFrame, roles: Roles) -> DataFrame:
    return group_by(df, F.to_date(roles.start), START_DATE, trips=row_count())
