"""Two fact tables in role form, built from the relational test tables.

* rides: each user event is a trip to the user's next event.
* sales: each order line is a trip from the supplier's to the customer's nation.

Both take the role names the caller needs and do no more work than those cost: a role
held by the fact table itself is a projection, any other adds the one left join that
supplies it. Left joins on unique keys neither drop nor repeat facts, so leaving an
unneeded one out cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.successor import with_successor
from wayfare.roles import Limits, Roles

# Special and sentinel location ids of the test bindings, and their limits.
_SPECIALS = {1: "EWR", 13: "JFK", 18: "LGA"}
_UNKNOWNS = (23, 24)

RIDES = Roles(specials=_SPECIALS, unknowns=_UNKNOWNS)
RIDES_LIMITS = Limits(year_max=2027)

SALES = Roles(specials=_SPECIALS, unknowns=_UNKNOWNS)
SALES_LIMITS = Limits(
    fare_min=2500.0,
    fare_max=100000.0,
    distance_max=45.0,
    duration_min=1440.0,
    duration_max=2592000.0,
    year_min=1990,
    year_max=2027,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RIDE_COLUMNS = [
    "event_id", "start_ts", "end_ts", "origin_id", "dest_id",
    "distance", "fare", "total", "rate_code", "party",
]


def rides(spark: SparkSession, folder: str, *need: str) -> DataFrame:
    """The named columns of the ride table (all of them when none are named)."""
    need = need or tuple(RIDE_COLUMNS)
    k = F.get_json_object("props", "$.k").try_cast("int")
    value = F.col("value")
    cheap = {
        "event_id": F.col("event_id"),
        "start_ts": F.col("ts"),
        "origin_id": F.col("user_id"),
        "dest_id": k,
        "distance": value,
        "fare": value,
        "total": value,
        "rate_code": F.nullif(k % 7, F.lit(0)).cast("double"),
        "party": (k % 8).cast("double"),
    }
    events = table(spark, folder, "events")
    if "end_ts" not in need:
        return events.select(*[cheap[c].alias(c) for c in need])
    keys = ["origin_id", "start_ts", "event_id"]
    carried = dict.fromkeys([*keys, *[c for c in need if c != "end_ts"]])
    facts = events.select(*[cheap[c].alias(c) for c in carried])
    return with_successor(facts, *keys, out="end_ts").select(*need)


SALE_COLUMNS = [
    "order_key", "line_number", "start_ts", "end_ts", "origin_id", "dest_id",
    "distance", "party", "rate_code", "flag", "fare", "tip", "total",
]


def sales(spark: SparkSession, folder: str, *need: str) -> DataFrame:
    """The named columns of the sales table (all of them when none are named)."""
    need = need or tuple(SALE_COLUMNS)
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    columns = {
        "order_key": F.col("l_orderkey"),
        "line_number": F.col("l_linenumber"),
        "start_ts": F.col("o_orderdate"),
        "end_ts": F.col("l_shipdate"),
        "origin_id": F.col("s_nationkey"),
        "dest_id": F.col("c_nationkey"),
        "distance": F.col("l_quantity"),
        "party": F.col("l_linenumber").cast("double"),
        "rate_code": F.nullif(F.col("l_linenumber") % 7, F.lit(0)).cast("double"),
        "flag": F.col("l_returnflag"),
        "fare": price,
        "tip": price * discount,
        "total": price * (1 - discount) * (1 + tax),
    }
    lines = table(spark, folder, "lineitem")
    if {"start_ts", "dest_id"} & set(need):
        orders = table(spark, folder, "orders")
        if "dest_id" in need:
            # Customers meet the orders, not the far more numerous lines, which then
            # shuffle by order key only.
            customer = table(spark, folder, "customer")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "origin_id" in need:
        supplier = table(spark, folder, "supplier")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines.select(*[columns[c].alias(c) for c in need])


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Location dimension: nation as zone, region as borough and service zone."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone"),
        F.col("r_name").alias("service_zone"),
    )
