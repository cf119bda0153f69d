"""Query registration and the two SQL views the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame, digits: int) -> DataFrame:
    """Types two engines agree on: doubles rounded, dates and timestamps as ISO text."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.round(column, digits).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return column.cast("string").alias(field.name)
        return column

    return df.select(*[plain(f) for f in df.schema])


def query(key: str, sql: str | None = None, digits: int = 6):
    """Register the decorated ``(spark, folder) -> DataFrame`` and its SQL, if it has one."""

    def add(run):
        if key in QUERIES:
            raise ValueError(f"query {key!r} is already registered")
        QUERIES[key] = lambda spark, folder: comparable(run(spark, folder), digits)
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


_RIDES = """
rides AS (
  SELECT event_id, ts AS start_ts,
         lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts,
         user_id AS origin_id, k AS dest_id, value AS distance, value AS fare, value AS total,
         CAST(nullif(k % 7, 0) AS DOUBLE) AS rate_code, CAST(k % 8 AS DOUBLE) AS party
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

_SALES = """
sales AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_orderdate AS start_ts,
         l_shipdate AS end_ts, s_nationkey AS origin_id, c_nationkey AS dest_id,
         l_quantity AS distance, CAST(l_linenumber AS DOUBLE) AS party,
         CAST(nullif(l_linenumber % 7, 0) AS DOUBLE) AS rate_code, l_returnflag AS flag,
         l_extendedprice AS fare, l_extendedprice * l_discount AS tip,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

_ZONES = """
zones AS (
  SELECT n_nationkey AS location_id, r_name AS borough, n_name AS zone, r_name AS service_zone
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

_DERIVED = """
{name}_d AS (
  SELECT *, (epoch(date_trunc('second', end_ts)) - epoch(date_trunc('second', start_ts))) / 60.0
              AS duration_min,
         CAST(start_ts AS DATE) AS start_date
  FROM {name}
)"""


def sql_with(*views: str, then: str) -> str:
    """``then`` after a WITH of the named views: rides, sales, zones, rides_d, sales_d."""
    bodies = {
        "rides": _RIDES,
        "sales": _SALES,
        "zones": _ZONES,
        "rides_d": _DERIVED.format(name="rides"),
        "sales_d": _DERIVED.format(name="sales"),
    }
    return "WITH " + ",".join(bodies[v] for v in views) + then


RIDES_KEEP = """
  fare BETWEEN 2.5 AND 250 AND distance > 0 AND distance < 100 AND party > 0
  AND duration_min BETWEEN 1 AND 180 AND origin_id NOT IN (23, 24) AND dest_id NOT IN (23, 24)
  AND year(start_date) BETWEEN 2009 AND 2027"""

SALES_KEEP = """
  fare BETWEEN 2500 AND 100000 AND distance > 0 AND distance < 45 AND party > 0
  AND duration_min BETWEEN 1440 AND 2592000 AND origin_id NOT IN (23, 24) AND dest_id NOT IN (23, 24)
  AND year(start_date) BETWEEN 1990 AND 2027"""

SALES_CUTOFF = "(SELECT quantile_disc(CAST(start_ts AS DATE), 0.8) FROM sales)"
