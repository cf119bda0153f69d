import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from wayfare.operators.features import basic_features, model_features
from wayfare.operators.history import HISTORY, join_history, zone_days, zone_history
from wayfare.operators.split import (
    day_counts,
    fixed_split,
    impute_from_train,
    is_test,
    is_train,
    period_split,
    resolved_split,
    split_counts,
    split_date,
    time_split,
)
from wayfare.operators.cleaning import with_derived
from wayfare.plans.features import (
    build_features,
    engineer,
    feature_columns,
    processed_columns,
    signal_airport,
    signal_by_hour,
    signal_by_weekday,
)
from wayfare.roles import START_DATE, TLC


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


@pytest.mark.parametrize(
    ("moment", "rush", "weekend"),
    [
        ("2024-01-08 06:59", 0, 0),
        ("2024-01-08 07:00", 1, 0),
        ("2024-01-08 09:59", 1, 0),
        ("2024-01-08 10:00", 0, 0),
        ("2024-01-08 16:00", 1, 0),
        ("2024-01-08 19:59", 1, 0),
        ("2024-01-08 20:00", 0, 0),
        ("2024-01-13 08:00", 0, 1),
        ("2024-01-14 17:00", 0, 1),
    ],
)
def test_regimes(trips, moment, rush, weekend):
    row = basic_features(trips({"tpep_pickup_datetime": dt.datetime.fromisoformat(moment)}), TLC).first()
    assert (row["is_rush_hour"], row["is_weekend"]) == (rush, weekend)


def test_row_features(trips):
    trip = {"tpep_pickup_datetime": dt.datetime(2024, 1, 8, 6), "trip_distance": math.e - 1}
    row = basic_features(trips(trip), TLC).first()
    assert (row["pickup_hour"], row["pickup_dayofweek"], row["pickup_month"]) == (6, 2, 1)
    assert row["log_distance"] == pytest.approx(1.0)
    assert (row["hour_sin"], row["hour_cos"]) == (pytest.approx(1.0), pytest.approx(0.0, abs=1e-12))
    assert row["dow_sin"] == pytest.approx(math.sin(2 * math.pi / 7))
    assert row["is_airport"] == 0
    assert len(model_features(TLC)) == 16
    assert len(feature_columns(TLC)) == 18


def history_by_day(trips, changes, calendar=False):
    days = zone_days(with_derived(trips(*changes), TLC), TLC)
    rows = zone_history(days, TLC, calendar).orderBy("start_date").collect()
    return [(r["start_date"].day, r["zone_prev_day_avg"], r["zone_7d_avg"]) for r in rows]


def test_history_by_rows_and_by_calendar(trips):
    changes = [{"tpep_pickup_datetime": day(n), "minutes": m} for n, m in ((1, 10), (2, 20), (3, 60), (12, 5))]
    assert history_by_day(trips, changes) == [
        (1, None, None),
        (2, 10.0, 10.0),
        (3, 20.0, 15.0),
        (12, 60.0, 30.0),
    ]
    assert history_by_day(trips, changes, calendar=True)[-1] == (12, 60.0, None)
    assert history_by_day(trips, changes, calendar=True)[2] == (3, 20.0, 15.0)


def test_history_never_sees_its_own_day(trips):
    changes = [{"tpep_pickup_datetime": day(n), "minutes": 10} for n in range(1, 10)]
    before = history_by_day(trips, changes)
    after = history_by_day(trips, [*changes, {"tpep_pickup_datetime": day(9, 18), "minutes": 100}])
    assert before == after


def test_history_looks_back_seven_rows(trips):
    changes = [{"tpep_pickup_datetime": day(n), "minutes": n} for n in range(1, 11)]
    assert history_by_day(trips, changes)[-1] == (10, 9.0, 6.0)  # mean of days 3..9


def test_join_keeps_every_row(trips):
    df = with_derived(trips({}, {"PULocationID": None}, {"tpep_pickup_datetime": day(9)}), TLC)
    joined = join_history(df, zone_history(zone_days(df, TLC), TLC), TLC)
    assert joined.count() == 3
    assert set(HISTORY) <= set(joined.columns)


def test_split_by_row_percentile(trips):
    df = with_derived(trips(*[{"tpep_pickup_datetime": day(n)} for n in range(1, 11)]), TLC)
    assert split_date(day_counts(df), 0.2).first()[0] == dt.date(2024, 1, 8)
    train, test = time_split(df, 0.2)
    assert (train.count(), test.count()) == (7, 3)
    assert train.unionAll(test).select("VendorID").distinct().count() == 10
    assert [p.count() for p in resolved_split(df, 0.2)] == [7, 3]


def test_undated_rows_are_counted_on_no_side(trips):
    days = [dt.datetime(2024, 1, 1 + n) for n in range(10)]
    df = with_derived(trips(*[{"tpep_pickup_datetime": d} for d in days]), TLC)
    df = df.withColumn(START_DATE, F.when(F.dayofmonth(START_DATE) > 3, F.col(START_DATE)))
    cutoff = split_date(day_counts(df), 0.2).scalar()
    counts = {r["part"]: r["rows"] for r in split_counts(df, is_train(cutoff), is_test(cutoff)).collect()}
    assert counts["undated"] == 3 and sum(counts.values()) == 10
    assert [p.count() for p in time_split(df, 0.2)] == [counts["train"], counts["test"]]


def test_split_of_one_day_trains_on_all(trips):
    df = with_derived(trips({}, {}), TLC)
    assert [p.count() for p in time_split(df, 0.2)] == [2, 0]
    assert [p.count() for p in resolved_split(df, 0.2)] == [2, 0]


def test_stray_dates_do_not_move_the_cutoff(trips):
    regular = [{"tpep_pickup_datetime": day(1 + n // 10)} for n in range(100)]
    df = with_derived(trips(*regular, {"tpep_pickup_datetime": dt.datetime(2098, 1, 1)}), TLC)
    assert split_date(day_counts(df), 0.2).first()[0] == dt.date(2024, 1, 9)


def test_fixed_and_period_splits(trips):
    df = with_derived(trips(*[{"tpep_pickup_datetime": day(n)} for n in range(1, 6)]), TLC)
    assert [p.count() for p in fixed_split(df, "2024-01-04")] == [3, 2]
    periods = period_split(df, ("2024-01-01", "2024-01-02"), ("2024-01-05", "2024-01-31"))
    assert [p.count() for p in periods] == [2, 1]


def test_imputation_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double").withColumn("empty", F.lit(None).cast("double"))
    test = spark.createDataFrame([(None, None), (100.0, 5.0)], "x double, empty double")
    filled_train, filled_test = impute_from_train(train, test, ["x", "empty"])
    assert sorted(column(filled_train, "x")) == [1.0, 2.0, 3.0]
    assert sorted(tuple(r) for r in filled_test.collect()) == [(2.0, 0.0), (100.0, 5.0)]


def test_build_features_equals_the_step_by_step_way(trips):
    changes = [
        {"tpep_pickup_datetime": day(1 + n % 11, n % 24), "minutes": 5 + n % 17, "PULocationID": [40, 50, None][n % 3]}
        for n in range(90)
    ]
    df = trips(*changes)
    built = build_features(df, TLC)
    train, test = impute_from_train(*time_split(engineer(df, TLC), 0.2), HISTORY)
    for ours, plain in ((built.train, train), (built.test, test)):
        got = ours.orderBy("VendorID").select("VendorID", *HISTORY).collect()
        want = plain.orderBy("VendorID").select("VendorID", *HISTORY).collect()
        assert [r[0] for r in got] == [r[0] for r in want]
        for a, b in zip(got, want, strict=True):
            assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
    report = built.report.first()
    assert (report["n_train"], report["n_test"]) == (train.count(), test.count())
    assert set(processed_columns(TLC)) <= set(built.train.columns)


def test_signals(trips):
    df = trips({"minutes": 20}, {"PULocationID": 132, "fare_amount": 70.0}, {"tpep_pickup_datetime": day(7, 3)})
    assert column(signal_by_hour(df, TLC), "pickup_hour") == [3, 12]
    weekdays = signal_by_weekday(df, TLC).collect()
    assert [(r["dow"], r["weekday"], r["trips"]) for r in weekdays] == [(1, "Sun", 1), (2, "Mon", 2)]
    groups = signal_airport(df, TLC).collect()
    assert [(r["group"], r["avg_fare"], r["trips"]) for r in groups] == [("Non-airport", 10.0, 2), ("Airport", 70.0, 1)]
