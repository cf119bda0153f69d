"""Feature engineering, location history, splitting, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.catalog.cleaning import derived_rides, derived_sales
from wayfare.catalog.registry import SALES_CUTOFF, query, sql_with
from wayfare.operators.cleaning import with_derived
from wayfare.operators.features import basic_features
from wayfare.operators.history import HISTORY, join_history, zone_days, zone_history
from wayfare.operators.split import (
    day_counts,
    impute_from_train,
    is_test,
    is_train,
    split_counts,
    split_date,
    time_split,
    within,
)
from wayfare.plans.features import (
    TEST_FRACTION,
    build_features,
    daily_trip_series,
    engineer,
    feature_columns,
    signal_airport,
    signal_by_hour,
    signal_by_weekday,
    stored_history,
)
from wayfare.roles import START_DATE
from wayfare.sources.sinks import stored
from wayfare.sources.tables import RIDES, SALES, rides, sales

_BASIC = """
  CAST(hour(start_ts) AS INTEGER) AS pickup_hour,
  CAST(dayofweek(start_ts) + 1 AS INTEGER) AS pickup_dayofweek,
  CAST(month(start_ts) AS INTEGER) AS pickup_month,
  CAST(dayofweek(start_ts) IN (0, 6) AS INTEGER) AS is_weekend,
  CAST(dayofweek(start_ts) NOT IN (0, 6) AND (hour(start_ts) BETWEEN 7 AND 9
       OR hour(start_ts) BETWEEN 16 AND 19) AS INTEGER) AS is_rush_hour,
  CAST(origin_id IN (1, 13, 18) OR dest_id IN (1, 13, 18) AS INTEGER) AS is_airport,
  round(ln(1 + distance), 9) AS log_distance,
  round(sin(2 * pi() * hour(start_ts) / 24), 9) AS hour_sin,
  round(cos(2 * pi() * hour(start_ts) / 24), 9) AS hour_cos,
  round(sin(2 * pi() * dayofweek(start_ts) / 7), 9) AS dow_sin,
  round(cos(2 * pi() * dayofweek(start_ts) / 7), 9) AS dow_cos"""

HISTORY_SQL = """, days AS (
  SELECT origin_id, start_date, count(*) AS trips, avg(duration_min) AS day_avg
  FROM rides_d GROUP BY 1, 2
), history AS (
  SELECT origin_id, start_date, day_avg,
         lag(day_avg) OVER (PARTITION BY origin_id ORDER BY start_date) AS zone_prev_day_avg,
         avg(day_avg) OVER (PARTITION BY origin_id ORDER BY start_date
                            ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS zone_7d_avg,
         avg(day_avg) OVER (PARTITION BY origin_id ORDER BY start_date
                            RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
           AS calendar_7d
  FROM days
)"""


@query("features_basic", sql_with("rides", then=f" SELECT event_id, {_BASIC} FROM rides"), digits=9)
def basics(spark, folder):
    needed = rides(spark, folder, "event_id", "start_ts", "origin_id", "dest_id", "distance")
    featured = basic_features(needed, RIDES)
    return featured.drop("start_ts", "origin_id", "dest_id", "distance", START_DATE)


@query(
    "features_full",
    sql_with(
        "rides",
        "rides_d",
        then=HISTORY_SQL
        + f"""
        SELECT event_id, distance, rate_code, party, origin_id, dest_id, fare, {_BASIC},
               round(duration_min, 9) AS duration_min, CAST(start_date AS VARCHAR) AS start_date,
               round(zone_prev_day_avg, 9) AS zone_prev_day_avg, round(zone_7d_avg, 9) AS zone_7d_avg
        FROM rides_d LEFT JOIN history USING (origin_id, start_date)""",
    ),
    digits=9,
)
def full(spark, folder):
    featured = engineer(rides(spark, folder), RIDES)
    return featured.select("event_id", *feature_columns(RIDES), "fare", "duration_min", START_DATE)


def _history(spark, folder, calendar=False):
    facts = derived_rides(spark, folder, "origin_id", "start_ts", "end_ts")
    return zone_history(zone_days(facts, RIDES), RIDES, calendar)


def _history_sql(column: str, alias: str) -> str:
    return sql_with(
        "rides",
        "rides_d",
        then=HISTORY_SQL
        + f""" SELECT origin_id, CAST(start_date AS VARCHAR) AS start_date,
                      round(day_avg, 6) AS day_avg, round({column}, 6) AS {alias} FROM history""",
    )


@query("zone_prev_day", _history_sql("zone_prev_day_avg", "zone_prev_day_avg"))
def previous_day(spark, folder):
    return _history(spark, folder).select("origin_id", START_DATE, "day_avg", "zone_prev_day_avg")


@query("zone_7d", _history_sql("zone_7d_avg", "zone_7d_avg"))
def last_seven_observed(spark, folder):
    return _history(spark, folder).select("origin_id", START_DATE, "day_avg", "zone_7d_avg")


@query("zone_7d_calendar", _history_sql("calendar_7d", "zone_7d_avg"))
def last_seven_calendar(spark, folder):
    return _history(spark, folder, calendar=True).select("origin_id", START_DATE, "day_avg", "zone_7d_avg")


@query(
    "zone_history_join",
    sql_with(
        "rides",
        "rides_d",
        then=HISTORY_SQL
        + """
        SELECT event_id, round(zone_prev_day_avg, 6) AS zone_prev_day_avg, round(zone_7d_avg, 6) AS zone_7d_avg
        FROM rides_d LEFT JOIN history USING (origin_id, start_date)""",
    ),
)
def history_joined(spark, folder):
    facts = derived_rides(spark, folder, "event_id", "origin_id", "start_ts", "end_ts")
    return join_history(facts, stored_history(facts, RIDES), RIDES).select("event_id", *HISTORY)


# Splits


@query("split_date", sql_with("sales", then=f" SELECT CAST({SALES_CUTOFF} AS VARCHAR) AS split_date"))
def cutoff(spark, folder):
    return split_date(day_counts(derived_sales(spark, folder, "start_ts", "end_ts")), TEST_FRACTION)


def _counts_sql(train: str, test: str, view: str = "sales") -> str:
    return sql_with(
        "sales",
        then=f""", undated AS (SELECT CASE WHEN order_key % 5 > 0 THEN start_ts END AS start_ts FROM sales)
        SELECT CASE WHEN {train} THEN 'train' WHEN {test} THEN 'test' WHEN start_ts IS NULL THEN 'undated' END AS part,
               count(*) AS rows, CAST(min(CAST(start_ts AS DATE)) AS VARCHAR) AS first,
               CAST(max(CAST(start_ts AS DATE)) AS VARCHAR) AS last
        FROM {view} GROUP BY 1 HAVING part IS NOT NULL""",
    )


def _dated_sales(spark, folder):
    return derived_sales(spark, folder, "start_ts", "end_ts")


def _cut_counts(facts, cutoff):
    return split_counts(facts, is_train(cutoff), is_test(cutoff))


@query(
    "time_split_counts",
    _counts_sql(f"CAST(start_ts AS DATE) < {SALES_CUTOFF}", f"CAST(start_ts AS DATE) >= {SALES_CUTOFF}"),
)
def time_split_counts(spark, folder):
    facts = _dated_sales(spark, folder)
    return _cut_counts(facts, split_date(day_counts(facts), TEST_FRACTION).scalar())


@query(
    "time_split_undated",
    _counts_sql(
        f"CAST(start_ts AS DATE) < {SALES_CUTOFF.replace('sales', 'undated')}",
        f"CAST(start_ts AS DATE) >= {SALES_CUTOFF.replace('sales', 'undated')}",
        "undated",
    ),
)
def time_split_undated(spark, folder):
    facts = sales(spark, folder, "order_key", "start_ts", "end_ts")
    start = F.when(F.col("order_key") % 5 > 0, F.col("start_ts"))
    dated = with_derived(facts.withColumn("start_ts", start), SALES)
    return _cut_counts(dated, split_date(day_counts(dated), TEST_FRACTION).scalar())


@query("fixed_split", _counts_sql("start_ts < DATE '2000-10-01'", "start_ts >= DATE '2000-10-01'"))
def fixed_split_counts(spark, folder):
    return _cut_counts(_dated_sales(spark, folder), F.lit("2000-10-01").cast("date"))


@query(
    "period_split",
    _counts_sql(
        "start_ts BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'",
        "start_ts BETWEEN DATE '2000-01-01' AND DATE '2000-01-31'",
    ),
)
def period_split_counts(spark, folder):
    parts = within("1999-01-01", "1999-12-31"), within("2000-01-01", "2000-01-31")
    return split_counts(_dated_sales(spark, folder), *parts)


FILLED_SQL = """, joined AS (
  SELECT * FROM rides_d LEFT JOIN history USING (origin_id, start_date)
), cut AS (
  SELECT quantile_disc(start_date, 0.8) AS d FROM rides_d
), means AS (
  SELECT avg(zone_prev_day_avg) AS prev, avg(zone_7d_avg) AS week FROM joined, cut WHERE start_date < d
)"""
_IMPUTED_SQL = sql_with(
    "rides",
    "rides_d",
    then=HISTORY_SQL
    + FILLED_SQL
    + """
    SELECT event_id, CASE WHEN start_date < d THEN 'train' ELSE 'test' END AS part,
           round(coalesce(zone_prev_day_avg, prev), 6) AS zone_prev_day_avg,
           round(coalesce(zone_7d_avg, week), 6) AS zone_7d_avg
    FROM joined, cut, means WHERE start_date IS NOT NULL""",
)


def _parts(train, test):
    columns = ["event_id", "part", *HISTORY]
    return (
        train.withColumn("part", F.lit("train"))
        .select(*columns)
        .unionByName(test.withColumn("part", F.lit("test")).select(*columns))
    )


@query("impute_train_mean", _IMPUTED_SQL)
def imputed(spark, folder):
    facts = derived_rides(spark, folder, "event_id", "origin_id", "start_ts", "end_ts")
    # stored, as the cutoff, the means and both parts read it
    joined = stored(join_history(facts, stored_history(facts, RIDES), RIDES), "joined")
    return _parts(*impute_from_train(*time_split(joined, TEST_FRACTION), HISTORY))


@query("build_features", _IMPUTED_SQL)
def built(spark, folder):
    features = build_features(rides(spark, folder), RIDES)
    return _parts(features.train, features.test)


@query(
    "feature_report",
    sql_with(
        "rides",
        "rides_d",
        then=HISTORY_SQL
        + FILLED_SQL
        + """
        SELECT count(*) FILTER (WHERE start_date < d) AS n_train,
               count(*) FILTER (WHERE start_date >= d) AS n_test,
               count(*) FILTER (WHERE start_date IS NULL) AS n_undated,
               CAST(any_value(d) AS VARCHAR) AS split_date, CAST(0.2 AS DOUBLE) AS test_fraction,
               18 AS n_features,
               round(any_value(prev), 6) AS fill_zone_prev_day_avg,
               round(any_value(week), 6) AS fill_zone_7d_avg
        FROM rides_d, cut, means""",
    ),
)
def report(spark, folder):
    return build_features(rides(spark, folder), RIDES).report


# Feature signals


@query(
    "signal.hour",
    sql_with(
        "rides",
        "rides_d",
        then="""
        SELECT CAST(hour(start_ts) AS INTEGER) AS pickup_hour, count(*) AS trips,
               round(avg(fare), 6) AS avg_fare, round(avg(duration_min), 6) AS avg_duration
        FROM rides_d GROUP BY 1""",
    ),
)
def hour_signal(spark, folder):
    return signal_by_hour(rides(spark, folder, "start_ts", "end_ts", "fare"), RIDES)


@query(
    "signal.weekday",
    sql_with(
        "rides",
        "rides_d",
        then="""
        SELECT CAST(dayofweek(start_ts) + 1 AS INTEGER) AS dow, count(*) AS trips,
               round(avg(duration_min), 6) AS avg_duration,
               ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][dayofweek(any_value(start_ts)) + 1] AS weekday
        FROM rides_d GROUP BY 1""",
    ),
)
def weekday_signal(spark, folder):
    return signal_by_weekday(rides(spark, folder, "start_ts", "end_ts"), RIDES)


@query(
    "signal.airport",
    sql_with(
        "sales",
        then="""
        SELECT CAST(origin_id IN (1, 13, 18) OR dest_id IN (1, 13, 18) AS INTEGER) AS is_airport,
               round(avg(fare), 6) AS avg_fare, round(avg(distance), 6) AS avg_distance, count(*) AS trips,
               CASE WHEN origin_id IN (1, 13, 18) OR dest_id IN (1, 13, 18)
                    THEN 'Airport' ELSE 'Non-airport' END AS "group"
        FROM sales GROUP BY 1, 5""",
    ),
)
def airport_signal(spark, folder):
    return signal_airport(sales(spark, folder, "origin_id", "dest_id", "fare", "distance"), SALES)


@query(
    "signal.daily",
    sql_with(
        "rides",
        then=" SELECT CAST(CAST(start_ts AS DATE) AS VARCHAR) AS start_date, count(*) AS trips FROM rides GROUP BY 1",
    ),
)
def daily_signal(spark, folder):
    return daily_trip_series(rides(spark, folder, "start_ts"), RIDES)
