import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import GOOD, column
from wayfare.operators.cleaning import (
    cleaning_report,
    cleaning_summary,
    date_window_rules,
    drop_column_and_nulls,
    keep_rows,
    modelling_rules,
    prepare_frame,
    rule_failures,
    standard_rules,
    with_derived,
)
from wayfare.roles import TLC, Limits

LIMITS = Limits(year_max=2025)


def kept(trips, rules, *changes):
    return sorted(column(keep_rows(with_derived(trips(*changes), TLC), rules), "VendorID"))


@pytest.mark.parametrize(
    ("field", "values", "expected"),
    [
        ("fare_amount", [2.49, 2.50, 250.0, 250.01, -5.0, None], [1, 2]),
        ("trip_distance", [0.0, 0.01, 99.99, 100.0, None], [1, 2]),
        ("passenger_count", [None, 0.0, 1.0, 6.0, 7.0], [2, 3, 4]),
        ("minutes", [59 / 60, 1, 180, 180 + 1 / 60, -5], [1, 2]),
        ("PULocationID", [264, 265, None, 263], [3]),
        ("DOLocationID", [264, 265, None, 1], [3]),
        (
            "tpep_pickup_datetime",
            [dt.datetime(y, 5, 1) for y in (2002, 2009, 2025, 2026, 2098)],
            [1, 2],
        ),
    ],
)
def test_rule_boundaries(trips, spark, field, values, expected):
    assert kept(trips, standard_rules(TLC, LIMITS), *[{field: v} for v in values]) == expected


def test_duration_cuts_subseconds_before_subtracting(trips):
    start = GOOD["tpep_pickup_datetime"]
    df = with_derived(
        trips(
            {
                "tpep_pickup_datetime": start + dt.timedelta(microseconds=900000),
                "tpep_dropoff_datetime": start + dt.timedelta(seconds=60, microseconds=100000),
            }
        ),
        TLC,
    )
    assert column(df, "duration_min") == [1.0]


def test_duration_is_wall_clock_over_a_dst_change(trips):
    df = trips(
        {
            "tpep_pickup_datetime": dt.datetime(2024, 3, 10, 1, 30),
            "tpep_dropoff_datetime": dt.datetime(2024, 3, 10, 3, 30),
        }
    )
    assert column(with_derived(df, TLC), "duration_min") == [120.0]


def test_derived_columns_are_added_once(trips):
    once = with_derived(trips({}), TLC).withColumn("duration_min", F.lit(7.0))
    assert column(with_derived(once, TLC), "duration_min") == [7.0]


def test_failures_count_false_or_null_and_overlap(trips):
    df = with_derived(
        trips({}, {"fare_amount": None, "trip_distance": 0.0}, {"fare_amount": 1.0}, {"PULocationID": None}), TLC
    )
    rules = standard_rules(TLC, LIMITS)
    counts = {r["rule"]: r["rows"] for r in rule_failures(df, rules).collect()}
    assert counts == {
        "fare_out_of_range": 2,
        "distance_out_of_range": 1,
        "passengers_missing_or_zero": 0,
        "duration_out_of_range": 0,
        "unknown_zone": 1,
        "invalid_pickup_date": 0,
    }
    summary = cleaning_summary(df, rules).first().asDict()
    assert summary == {"n_input": 4, "n_output": 1, "n_removed": 3, "pct_removed": 75.0, "pct_kept": 25.0}
    assert cleaning_report(df, rules).first().asDict() == summary | counts


def test_summary_of_nothing(trips):
    empty = with_derived(trips({}).limit(0), TLC)
    assert cleaning_summary(empty, standard_rules(TLC, LIMITS)).first()["pct_kept"] == 100.0


def test_default_year_ceiling_is_next_year(trips):
    this_year = dt.date.today().year
    changes = [{"tpep_pickup_datetime": dt.datetime(this_year + n, 1, 1)} for n in (0, 1, 2)]
    assert kept(trips, standard_rules(TLC, Limits()), *changes) == [0, 1]


def test_rule_variants(trips):
    changes = [
        {"tpep_pickup_datetime": dt.datetime(2023, 12, 31, 23)},
        {"tpep_pickup_datetime": dt.datetime(2024, 1, 1)},
        {"tpep_pickup_datetime": dt.datetime(2025, 12, 31, 23)},
        {"tpep_pickup_datetime": dt.datetime(2024, 6, 1), "minutes": 500},
    ]
    assert kept(trips, date_window_rules(TLC, LIMITS, "2024-01-01", "2025-12-31"), *changes) == [1, 2]
    assert kept(trips, modelling_rules(TLC, LIMITS), *changes) == [0, 1, 2, 3]


def test_null_handling(trips):
    df = trips({}, {"fare_amount": None}, {"RatecodeID": None})
    some = df.select("VendorID", "fare_amount", "RatecodeID", "airport_fee")
    assert column(drop_column_and_nulls(some, "airport_fee"), "VendorID") == [0]
    ready = prepare_frame(some, TLC, "fare_amount").orderBy("VendorID").collect()
    assert [(r["VendorID"], r["RatecodeID"]) for r in ready] == [(0, 1.0), (2, 1.0)]
