"""Derived columns, keep-rules, sampling, location joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.catalog.registry import RIDES_KEEP, SALES_KEEP, query, sql_with
from wayfare.functions.labels import rate_code_label
from wayfare.functions.sampling import cap_rows, first_by_hash, sampled_projection
from wayfare.operators.aggregates import row_count
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
from wayfare.operators.locations import (
    hotspots,
    hotspots_long,
    in_service_zones,
    location_counts,
    outside_unknown,
    with_zone_label,
)
from wayfare.operators.quality import implausible_share
from wayfare.roles import DURATION, START_DATE
from wayfare.sources.tables import RIDES, RIDES_LIMITS, SALES, SALES_LIMITS, rides, sales, table, zones


def derived_rides(spark, folder, *need):
    return with_derived(rides(spark, folder, *need), RIDES)


def derived_sales(spark, folder, *need):
    return with_derived(sales(spark, folder, *need), SALES)


@query(
    "derive_duration",
    sql_with(
        "rides",
        "rides_d",
        then="""
        SELECT event_id, round(duration_min, 6) AS duration_min, CAST(start_date AS VARCHAR) AS start_date
        FROM rides_d""",
    ),
)
def derive_duration(spark, folder):
    return derived_rides(spark, folder, "event_id", "start_ts", "end_ts").select("event_id", DURATION, START_DATE)


@query(
    "clean_rows",
    sql_with(
        "rides",
        "rides_d",
        then=f" SELECT event_id, fare, round(duration_min, 6) AS duration_min FROM rides_d WHERE {RIDES_KEEP}",
    ),
)
def clean_rides(spark, folder):
    kept = keep_rows(derived_rides(spark, folder), standard_rules(RIDES, RIDES_LIMITS))
    return kept.select("event_id", "fare", DURATION)


@query(
    "clean_rows.sales",
    sql_with(
        "sales",
        "sales_d",
        then=f" SELECT order_key, line_number, fare, duration_min FROM sales_d WHERE {SALES_KEEP}",
    ),
)
def clean_sales(spark, folder):
    kept = keep_rows(derived_sales(spark, folder), standard_rules(SALES, SALES_LIMITS))
    return kept.select("order_key", "line_number", "fare", DURATION)


@query(
    "clean_date_window",
    sql_with(
        "sales",
        "sales_d",
        then=f"""
        SELECT order_key, line_number, CAST(start_date AS VARCHAR) AS start_date, fare FROM sales_d
        WHERE {SALES_KEEP} AND start_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    ),
)
def clean_date_window(spark, folder):
    rules = date_window_rules(SALES, SALES_LIMITS, "1996-01-01", "1997-12-31")
    kept = keep_rows(derived_sales(spark, folder), rules)
    return kept.select("order_key", "line_number", START_DATE, "fare")


@query(
    "clean_subset",
    sql_with(
        "rides",
        then="""
        SELECT event_id, fare, distance, party FROM rides
        WHERE fare BETWEEN 2.5 AND 250 AND distance > 0 AND distance < 100 AND party > 0""",
    ),
)
def clean_subset(spark, folder):
    facts = rides(spark, folder, "event_id", "fare", "distance", "party")
    return keep_rows(facts, modelling_rules(RIDES, RIDES_LIMITS))


_SUMMARY = """
  SELECT n_input, n_output, n_input - n_output AS n_removed,
         round((n_input - n_output) / n_input * 100, 6) AS pct_removed,
         round(100 - (n_input - n_output) / n_input * 100, 6) AS pct_kept
  FROM (SELECT count(*) AS n_input, count(*) FILTER (WHERE {keep}) AS n_output FROM {view})"""


@query("clean_summary", sql_with("rides", "rides_d", then=_SUMMARY.format(keep=RIDES_KEEP, view="rides_d")))
def summary_rides(spark, folder):
    return cleaning_summary(derived_rides(spark, folder), standard_rules(RIDES, RIDES_LIMITS))


@query("clean_summary.sales", sql_with("sales", "sales_d", then=_SUMMARY.format(keep=SALES_KEEP, view="sales_d")))
def summary_sales(spark, folder):
    return cleaning_summary(derived_sales(spark, folder), standard_rules(SALES, SALES_LIMITS))


# rule name -> the condition a kept row meets
_RIDE_RULES = {
    "fare_out_of_range": "fare BETWEEN 2.5 AND 250",
    "distance_out_of_range": "distance > 0 AND distance < 100",
    "passengers_missing_or_zero": "party > 0",
    "duration_out_of_range": "duration_min BETWEEN 1 AND 180",
    "unknown_zone": "origin_id NOT IN (23, 24) AND dest_id NOT IN (23, 24)",
    "invalid_pickup_date": "year(start_date) BETWEEN 2009 AND 2027",
}


def _failing(keep: str) -> str:
    return f"count(*) FILTER (WHERE ({keep}) IS NOT TRUE)"


@query(
    "clean_breakdown",
    sql_with(
        "rides",
        "rides_d",
        then=" "
        + " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, {_failing(keep)} AS rows FROM rides_d" for rule, keep in _RIDE_RULES.items()
        ),
    ),
)
def breakdown(spark, folder):
    return rule_failures(derived_rides(spark, folder), standard_rules(RIDES, RIDES_LIMITS))


_FAILING_COLUMNS = ", ".join(f"{_failing(keep)} AS {rule}" for rule, keep in _RIDE_RULES.items())


@query(
    "clean_report",
    sql_with(
        "rides",
        "rides_d",
        then=f"""
        SELECT * FROM ({_SUMMARY.format(keep=RIDES_KEEP, view="rides_d")}),
                      (SELECT {_FAILING_COLUMNS} FROM rides_d)""",
    ),
)
def report(spark, folder):
    return cleaning_report(derived_rides(spark, folder), standard_rules(RIDES, RIDES_LIMITS))


@query(
    "dropna_any",
    sql_with(
        "rides",
        then="""
        SELECT event_id, strftime(end_ts, '%Y-%m-%d %H:%M:%S.%f') AS end_ts, rate_code, party FROM rides
        WHERE end_ts IS NOT NULL AND rate_code IS NOT NULL""",
    ),
)
def dropna_any(spark, folder):
    kept = drop_column_and_nulls(rides(spark, folder, "event_id", "end_ts", "rate_code", "party", "total"), "total")
    return kept.withColumn("end_ts", F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "implausible_share",
    sql_with(
        "rides",
        then="""
        SELECT count(*) AS rows, count(*) FILTER (WHERE fare <= 0 OR fare > 250) AS implausible,
               round(count(*) FILTER (WHERE fare <= 0 OR fare > 250) / count(*) * 100, 6) AS pct
        FROM rides""",
    ),
)
def implausible_fares(spark, folder):
    return implausible_share(rides(spark, folder, "fare"), RIDES.fare, RIDES_LIMITS.fare_max)


@query(
    "prepare_frame",
    sql_with(
        "rides",
        "rides_d",
        then="""
        SELECT event_id, coalesce(rate_code, 1.0) AS rate_code, round(duration_min, 6) AS duration_min
        FROM rides_d WHERE duration_min IS NOT NULL""",
    ),
)
def prepared(spark, folder):
    facts = derived_rides(spark, folder, "event_id", "start_ts", "end_ts", "rate_code")
    return prepare_frame(facts, RIDES, DURATION).select("event_id", "rate_code", DURATION)


# Sampling: the SQL repeats the key hash, so the very same rows must come out.

_UNIT = "(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)"


@query(
    "sample_dist",
    sql_with(
        "rides",
        "rides_d",
        then=f"""
        SELECT event_id, fare, round(duration_min, 6) AS duration_min, distance FROM rides_d
        WHERE {_UNIT} < 0.01""",
    ),
)
def sample_dist(spark, folder):
    columns = ["fare", DURATION, "distance"]
    return sampled_projection(derived_rides(spark, folder), columns, ["event_id"], 0.01)


@query(
    "sample_distance_fare",
    sql_with(
        "rides",
        then=f" SELECT event_id, distance, fare FROM rides WHERE {_UNIT} < 0.001",
    ),
)
def sample_distance_fare(spark, folder):
    facts = rides(spark, folder, "event_id", "distance", "fare")
    return sampled_projection(facts, ["distance", "fare"], ["event_id"], 0.001)


@query(
    "cap_rows",
    sql_with(
        "rides",
        then=f" SELECT event_id, fare FROM rides WHERE {_UNIT} < least(1.0, 5000.0 / (SELECT count(*) FROM rides))",
    ),
)
def capped(spark, folder):
    return cap_rows(rides(spark, folder, "event_id", "fare"), 5000, "event_id")


@query("sample_repeated_keys", "SELECT least(500, count(*)) AS few, least(4000, count(*)) AS many FROM events")
def sample_repeated_keys(spark, folder):
    """Samples by a key that every row shares with many, NULLs included, are complete."""
    keyed = table(spark, folder, "events").select(F.nullif(F.col("user_id") % 10, F.lit(0)).alias("key"))
    few = first_by_hash(keyed, 500, "key").agg(row_count().alias("few"))
    return few.select("few", first_by_hash(keyed, 4000, "key").agg(row_count().alias("many")).scalar().alias("many"))


# Location joins


@query(
    "label_zones",
    sql_with(
        "sales",
        "zones",
        then="""
        SELECT origin_id AS location_id, count(*) AS trips,
               coalesce(max(zone || ' (' || borough || ')'), 'Unknown (' || origin_id || ')') AS zone
        FROM sales LEFT JOIN zones ON origin_id = location_id GROUP BY origin_id""",
    ),
)
def label_zones(spark, folder):
    counts = location_counts(sales(spark, folder, "origin_id"), "origin_id")
    return with_zone_label(counts, zones(spark, folder), "location_id", default="Unknown ({})")


@query(
    "label_ratecode",
    sql_with(
        "rides",
        then="""
        SELECT event_id, CASE CAST(rate_code AS INTEGER) WHEN 1 THEN 'Standard rate' WHEN 2 THEN 'JFK'
               WHEN 3 THEN 'Newark' WHEN 4 THEN 'Nassau / Westchester' WHEN 5 THEN 'Negotiated fare'
               WHEN 6 THEN 'Group ride' END AS label
        FROM rides""",
    ),
)
def label_ratecode(spark, folder):
    facts = rides(spark, folder, "event_id", "rate_code")
    return facts.select("event_id", rate_code_label(F.col("rate_code")).alias("label"))


@query(
    "airport_semi",
    sql_with(
        "sales",
        "zones",
        then="""
        SELECT origin_id AS location_id, count(*) AS trips FROM sales
        WHERE origin_id IN (SELECT location_id FROM zones WHERE service_zone IN ('ASIA', 'EUROPE'))
        GROUP BY 1""",
    ),
)
def airport_semi(spark, folder):
    facts = sales(spark, folder, "origin_id")
    picked = in_service_zones(facts, zones(spark, folder), "origin_id", ["ASIA", "EUROPE"])
    return location_counts(picked, "origin_id")


@query(
    "unknown_anti",
    sql_with(
        "sales",
        then=" SELECT dest_id AS location_id, count(*) AS trips FROM sales WHERE dest_id NOT IN (23, 24) GROUP BY 1",
    ),
)
def unknown_anti(spark, folder):
    facts = sales(spark, folder, "dest_id")
    return location_counts(outside_unknown(facts, zones(spark, folder), "dest_id", SALES.unknowns), "dest_id")


@query(
    "hotspot_long",
    sql_with(
        "sales",
        "zones",
        then=""", hot AS (
          SELECT zone || ' (' || borough || ')' AS zone, pickups,
                 (SELECT count(*) FROM sales WHERE dest_id = p.origin_id) AS dropoffs
          FROM (SELECT origin_id, count(*) AS pickups FROM sales WHERE origin_id NOT IN (23, 24)
                GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) p
          JOIN zones ON p.origin_id = location_id)
        SELECT zone, 'pickups' AS side, pickups AS trips FROM hot
        UNION ALL SELECT zone, 'dropoffs', dropoffs FROM hot""",
    ),
)
def hotspot_long(spark, folder):
    facts = sales(spark, folder, "origin_id", "dest_id")
    return hotspots_long(hotspots(facts, SALES, zones(spark, folder)))
