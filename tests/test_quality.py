import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from wayfare.operators.cleaning import standard_rules, with_derived
from wayfare.operators.distinct import period_sketches, relative_error, united_distinct
from wayfare.operators.quality import (
    categorical_distribution,
    classify_columns,
    clipped_histogram,
    column_profile,
    distinct_counts,
    duplicate_rows,
    duplicate_rows_approx,
    implausible_share,
    missing_per_column,
    numeric_summary,
    sanity_block,
    target_audit,
)
from wayfare.operators.report import quality_report
from wayfare.roles import TLC, Limits

LIMITS = Limits(year_max=2025)


def test_missing_lists_only_columns_with_nulls(trips):
    df = trips({}, {"fare_amount": None}, {"fare_amount": None, "PULocationID": None}, {}).select(
        "VendorID", "fare_amount", "PULocationID"
    )
    rows = [tuple(r) for r in missing_per_column(df).collect()]
    assert rows == [("fare_amount", 2, 50.0), ("PULocationID", 1, 25.0)]


def test_sanity_is_wider_than_cleaning(trips):
    df = with_derived(
        trips(
            {"fare_amount": 1.0},  # removed by cleaning, plausible here
            {"fare_amount": 0.0},
            {"fare_amount": None},
            {"passenger_count": None},
            {"trip_distance": 0.0},
            {"trip_distance": 100.0},
            {"minutes": 0},
            {"minutes": 181},
        ),
        TLC,
    )
    counts = {r["check"]: r["rows"] for r in sanity_block(df, TLC, LIMITS).collect()}
    assert counts == {
        "implausible_fare": 1,
        "zero_distance": 1,
        "extreme_distance": 1,
        "bad_passenger_count": 1,
        "bad_duration": 2,
    }
    share = implausible_share(df, "fare_amount", 250.0).first()
    assert (share["rows"], share["implausible"], share["pct"]) == (8, 1, 12.5)


@pytest.mark.parametrize("compare_rows", [False, True])
def test_duplicates_are_exact(spark, compare_rows):
    rows = [(1, "a", 0.0)] * 3 + [(1, "a", -0.0), (1, None, 0.0), (1, None, 0.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "id int, name string, x double").repartition(3)
    assert tuple(duplicate_rows(df, compare_rows).first()) == (7, 3, 4)
    assert tuple(duplicate_rows(df.filter("id = 2"), compare_rows).first()) == (1, 1, 0)
    assert tuple(duplicate_rows(df.limit(0), compare_rows).first()) == (0, 0, 0)
    swapped = spark.createDataFrame([(1, None), (None, 1), (None, None)], "a int, b int")
    assert tuple(duplicate_rows(swapped, compare_rows).first()) == (3, 3, 0)


def test_duplicate_estimate_is_close(spark):
    df = spark.range(20000).selectExpr("id % 15000 AS k")
    row = duplicate_rows_approx(df).first()
    assert row["rows"] == 20000
    assert row["approx_duplicates"] == pytest.approx(5000, abs=1000)


@pytest.mark.parametrize("exact", [True, False])
def test_numeric_summary(spark, exact):
    df = spark.createDataFrame([(float(i), 2) for i in range(1, 6)] + [(None, 2)], "x double, k int")
    got = {(r["column"], r["statistic"]): r["value"] for r in numeric_summary(df, ["x", "k"], exact).collect()}
    assert got["x", "count"] == 5
    assert got["x", "mean"] == 3
    assert got["x", "stddev"] == pytest.approx(1.5811388)
    assert [got["x", s] for s in ("min", "25%", "50%", "75%", "max")] == [1, 2, 3, 4, 5]
    assert got["k", "50%"] == 2
    assert len(got) == 16


@pytest.mark.parametrize("exact", [True, False])
def test_target_audit(spark, exact):
    df = spark.createDataFrame([(float(v),) for v in (-1, 10, 20, 30, 300)], "fare double")
    got = {r["measure"]: r["value"] for r in target_audit(df, "fare", 250.0, exact).collect()}
    assert (got["min"], got["median"], got["max"], got["negative"], got["above_cap"]) == (-1, 20, 300, 1, 1)
    assert got["p99_99"] == pytest.approx(300, rel=0.01)


def test_histogram_counts_every_row_once(trips):
    df = with_derived(trips({}, {"fare_amount": -500.0}, {"fare_amount": 9999.0}, {"fare_amount": None}), TLC)
    rows = clipped_histogram(df, {"fare_amount": (-20, 300)}, standard_rules(TLC, LIMITS)).collect()
    bins = {r["bin"]: (r["before"], r["after"]) for r in rows}
    assert bins == {1: (1, 0), 6: (1, 1), 60: (1, 0)}


def test_distributions_and_profiles(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("a", 2, None), ("b", None, 2.5)], "s string, i int, d double")
    assert [tuple(r) for r in categorical_distribution(df, ["s"]).collect()] == [("s", "a", 2), ("s", "b", 1)]
    assert [tuple(r) for r in distinct_counts(df, ["i", "s"]).collect()] == [("i", 2), ("s", 2)]
    typed = df.selectExpr("*", "timestamp_ntz'2024-01-01' AS t", "array(1) AS a")
    assert classify_columns(typed) == {
        "s": "categorical",
        "i": "numeric",
        "d": "numeric",
        "t": "timestamp",
        "a": "other",
    }
    assert column(column_profile(df), "non_null") == [2, 2, 3]


def test_report_reads_the_table_once(spark, trips):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    plain = with_derived(trips({}, {}, {"fare_amount": -1.0, "passenger_count": None}), TLC).cache()
    df = plain.mapInArrow(count, plain.schema)
    got = {(r["section"], r["subject"], r["measure"]): r["value"] for r in quality_report(df, TLC, Limits(year_max=2026), ["fare_amount"]).collect()}
    assert read.value == 3
    assert got["table", "all", "rows"] == 3 and got["table", "all", "duplicates"] == 0
    assert got["missing", "passenger_count", "rows"] == 1 and got["missing", "passenger_count", "pct"] == pytest.approx(100 / 3)
    assert got["sanity", "implausible_fare", "rows"] == 1 and got["numeric", "fare_amount", "mean"] == pytest.approx(19 / 3)
    empty = {(r["section"], r["measure"]): r["value"] for r in quality_report(plain.limit(0), TLC, Limits(year_max=2026), ["fare_amount"]).collect()}
    assert empty["numeric", "mean"] is None and empty["sanity", "pct"] == 0.0


def test_report_counts_again_when_observed_rows_are_off(spark, trips, monkeypatch):
    """As after a map task ran twice: the observed row count differs from the action's."""
    from wayfare.operators import report

    class Doubled(report.Observation):
        @property
        def get(self):
            return {k: v * 2 if isinstance(v, int) else v for k, v in super().get.items()}

    monkeypatch.setattr(report, "Observation", Doubled)
    df = with_derived(trips({}, {"fare_amount": -1.0}), TLC)
    got = {(r["section"], r["subject"], r["measure"]): r["value"] for r in quality_report(df, TLC, Limits(year_max=2026), ["fare_amount"]).collect()}
    assert got["table", "all", "rows"] == 2 and got["sanity", "implausible_fare", "rows"] == 1


def test_sketches_of_periods_unite(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS month", "id % 20000 AS x", "IF(id % 2 = 0, NULL, CAST(id % 10 AS DOUBLE)) AS y", "'c' AS one")
    sketches = period_sketches(df, ["x", "y", "one"], F.col("month")).cache()
    assert sketches.count() == 9
    got = {r["column"]: (r["rows"], r["distinct_values"]) for r in united_distinct(sketches).collect()}
    assert abs(got["x"][1] - 20_000) <= 5 * relative_error() * 20_000 and got["y"] == (60_000, 5) and got["one"] == (60_000, 1)
    some = {r["column"]: r["distinct_values"] for r in united_distinct(sketches.filter("period = 1")).collect()}
    assert abs(some["x"] - 20_000) <= 5 * relative_error() * 20_000
    assert united_distinct(sketches, "period").count() == 9
    nothing = period_sketches(df.limit(0), ["x"], F.col("month"))
    assert nothing.collect() == [] and united_distinct(nothing).collect() == []
