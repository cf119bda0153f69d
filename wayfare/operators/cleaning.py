"""Derived columns and named keep-rules.

One list of :class:`Rule` drives the filter, the per-rule failure counts and the
before/after summary, so the three can never disagree.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.timeparts import minutes_between
from wayfare.roles import DURATION, START_DATE, Limits, Roles


class Rule(NamedTuple):
    """A row is kept only where ``keep`` is true; NULL counts as a failure."""

    name: str
    keep: Column

    @property
    def fails(self) -> Column:
        return ~F.coalesce(self.keep, F.lit(False))


def with_derived(df: DataFrame, roles: Roles) -> DataFrame:
    """Add the duration in minutes and the start date, unless already there.

    A trip still to be scored has no end column and gets no duration.
    """
    wanted = {START_DATE: F.to_date(roles.start)}
    if roles.end in df.columns:
        wanted[DURATION] = minutes_between(roles.start, roles.end)
    return df.withColumns({name: c for name, c in wanted.items() if name not in df.columns})


def fare_rule(roles: Roles, limits: Limits) -> Rule:
    return Rule("fare_out_of_range", F.col(roles.fare).between(limits.fare_min, limits.fare_max))


def distance_rule(roles: Roles, limits: Limits) -> Rule:
    distance = F.col(roles.distance)
    inside = (distance > limits.distance_min) & (distance < limits.distance_max)
    return Rule("distance_out_of_range", inside)


def party_rule(roles: Roles) -> Rule:
    return Rule("passengers_missing_or_zero", F.col(roles.party) > 0)


def duration_rule(limits: Limits) -> Rule:
    inside = F.col(DURATION).between(limits.duration_min, limits.duration_max)
    return Rule("duration_out_of_range", inside)


def zone_rule(roles: Roles) -> Rule:
    return Rule("unknown_zone", roles.is_known(roles.origin) & roles.is_known(roles.dest))


def year_rule(limits: Limits) -> Rule:
    """Years as a date range, which reaches the scan where ``year(...)`` would not."""
    first = F.make_date(F.lit(limits.year_min), F.lit(1), F.lit(1))
    after = F.make_date(limits.year_ceiling() + 1, F.lit(1), F.lit(1))
    date = F.col(START_DATE)
    return Rule("invalid_pickup_date", (date >= first) & (date < after))


def date_window_rule(first: str, last: str) -> Rule:
    """Both ends inclusive, ISO dates."""
    inside = F.col(START_DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return Rule("invalid_pickup_date", inside)


def standard_rules(roles: Roles, limits: Limits) -> list[Rule]:
    return [
        fare_rule(roles, limits),
        distance_rule(roles, limits),
        party_rule(roles),
        duration_rule(limits),
        zone_rule(roles),
        year_rule(limits),
    ]


def date_window_rules(roles: Roles, limits: Limits, first: str, last: str) -> list[Rule]:
    """The standard rules with a fixed date window in place of the year range."""
    return [*standard_rules(roles, limits)[:-1], date_window_rule(first, last)]


def modelling_rules(roles: Roles, limits: Limits) -> list[Rule]:
    """The shorter list used right before fitting: fare, distance, group size."""
    return [fare_rule(roles, limits), distance_rule(roles, limits), party_rule(roles)]


def keeps_all(rules: list[Rule]) -> Column:
    return reduce(and_, [rule.keep for rule in rules])


def keep_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.filter(keeps_all(rules))


def _counts(rules: list[Rule]) -> list[Column]:
    kept = F.count_if(keeps_all(rules))
    return [F.count(F.lit(1)).alias("n_input"), kept.alias("n_output")]


def _failures(rules: list[Rule]) -> list[Column]:
    return [F.count_if(rule.fails).alias(rule.name) for rule in rules]


def _with_shares(counted: DataFrame, *more: str) -> DataFrame:
    removed = F.col("n_input") - F.col("n_output")
    share = F.when(F.col("n_input") > 0, removed / F.col("n_input") * 100.0).otherwise(0.0)
    return counted.select(
        "n_input",
        "n_output",
        removed.alias("n_removed"),
        share.alias("pct_removed"),
        (100.0 - share).alias("pct_kept"),
        *more,
    )


def cleaning_summary(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: rows in, out and removed with percentages; a single scan."""
    return _with_shares(df.agg(*_counts(rules)))


def cleaning_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The summary plus one column of failing rows per rule, still in a single scan."""
    return _with_shares(df.agg(*_counts(rules), *_failures(rules)), *[rule.name for rule in rules])


def rule_failures(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, rows) with the rows failing each rule; a row may fail several."""
    counts = df.agg(*_failures(rules))
    return counts.unpivot([], [rule.name for rule in rules], "rule", "rows").orderBy("rule")


def drop_column_and_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Drop the named columns, then every row that has any NULL left."""
    return df.drop(*columns).dropna("any")


def prepare_frame(df: DataFrame, roles: Roles, target: str, rate_code: float = 1.0) -> DataFrame:
    """Fill a missing rate code and drop rows without a target."""
    return df.fillna({roles.rate_code: rate_code}).filter(F.col(target).isNotNull())
