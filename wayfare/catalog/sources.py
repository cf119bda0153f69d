"""Loading, schema reconciliation, coverage and the Parquet sink."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.catalog.features import FILLED_SQL, HISTORY_SQL
from wayfare.catalog.registry import query, sql_with
from wayfare.functions.timeparts import month_start
from wayfare.operators.aggregates import row_count
from wayfare.operators.coverage import coverage_summary, period_gaps, periods_present
from wayfare.plans.features import write_processed
from wayfare.sources.footers import folder_coverage, footer_stats, footers
from wayfare.sources.incremental import manifest, sync_months, synced
from wayfare.sources.monthly import file_stats, folder_files, load_folder, load_months, load_stats
from wayfare.sources.schemas import cast_present, columns, conform, project, schema_drift, union_by_name
from wayfare.sources.sinks import shared_folder, stored, write_partitioned
from wayfare.sources.tables import RIDES, SALES, rides, sales, table, zones
from wayfare.sources.zones import read_zones


@query(
    "load_cast",
    """SELECT * REPLACE (CAST(l_linenumber AS DOUBLE) AS l_linenumber,
                         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate)
       FROM lineitem""",
)
def load_cast(spark, folder):
    return cast_present(table(spark, folder, "lineitem"), ["l_linenumber", "l_extendedprice", "airport_fee"])


_ORDERS = columns(
    order_key=T.LongType(),
    customer=T.LongType(),
    ordered=T.TimestampNTZType(),
    total=T.DoubleType(),
    priority=T.StringType(),
)


def _drifted_orders(spark, folder):
    """The orders table cut by date ranges, which reach the scan, into three vintages, each with its own schema."""
    ordered = F.col("o_orderdate")
    second, third = (F.lit(f"{year}-01-01").cast("timestamp_ntz") for year in (1997, 1999))
    orders = table(spark, folder, "orders").withColumn("year", F.year(ordered))
    old = orders.filter(ordered < second).select(
        F.col("o_orderkey").cast("int").alias("order_key"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("ordered"),
        F.floor("o_totalprice").cast("int").alias("total"),
        "year",
    )
    middle = orders.filter((ordered >= second) & (ordered < third)).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("ordered"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").cast("double").alias("customer"),
        "year",
    )
    new = orders.filter((ordered >= third) | ordered.isNull()).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("ordered"),
        F.col("o_totalprice").cast("float").cast("double").alias("Total"),
        F.col("o_orderpriority").alias("Priority"),
        F.lit(0).alias("extra_fee"),
        "year",
    )
    return {"old": old, "middle": middle, "new": new}


_DRIFTED = """
  SELECT o_orderkey, o_custkey, o_orderdate, year(o_orderdate) AS y,
         CASE WHEN year(o_orderdate) < 1997 THEN floor(o_totalprice)
              WHEN year(o_orderdate) < 1999 THEN o_totalprice
              ELSE CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) END AS total,
         CASE WHEN year(o_orderdate) >= 1997 THEN o_orderpriority END AS priority
  FROM orders"""


@query(
    "conform_schema",
    f"""SELECT o_orderkey AS order_key, o_custkey AS customer,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered, round(total, 3) AS total, priority
        FROM ({_DRIFTED})""",
    digits=3,
)
def conform_schema(spark, folder):
    return union_by_name([conform(v, _ORDERS) for v in _drifted_orders(spark, folder).values()])


@query(
    "load_union",
    f"""SELECT CAST(y AS INTEGER) AS year, count(*) AS orders, round(sum(total), 2) AS total,
               count(priority) AS with_priority, count(o_custkey) AS with_customer, '2099' AS missing
        FROM ({_DRIFTED}) GROUP BY 1""",
    digits=2,
)
def load_union(spark, folder):
    base = shared_folder(spark, "vintages")
    paths = {"2099": f"{base}/new/year=2099"}
    for name, vintage in _drifted_orders(spark, folder).items():
        write_partitioned(vintage, f"{base}/{name}", "year")
        for row in vintage.select("year").distinct().collect():
            value = "__HIVE_DEFAULT_PARTITION__" if row["year"] is None else row["year"]
            paths[str(value)] = f"{base}/{name}/year={value}"
    loaded = load_months(spark, paths, schema=_ORDERS)
    return (
        loaded.df.groupBy(F.year("ordered").alias("year"))
        .agg(
            row_count().alias("orders"),
            F.sum("total").alias("total"),
            F.count("priority").alias("with_priority"),
            F.count("customer").alias("with_customer"),
        )
        .withColumn("missing", F.lit(",".join(loaded.missing)))
    )


_NEEDED = columns(
    start_ts=T.TimestampNTZType(),
    end_ts=T.TimestampNTZType(),
    party=T.DoubleType(),
    distance=T.DoubleType(),
    rate_code=T.DoubleType(),
    origin_id=T.IntegerType(),
    dest_id=T.IntegerType(),
    fare=T.DoubleType(),
)


@query(
    "project_needed",
    sql_with(
        "sales",
        then="""
        SELECT strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
               strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts,
               party, distance, rate_code, origin_id, dest_id, fare FROM sales""",
    ),
)
def project_needed(spark, folder):
    return project(sales(spark, folder), _NEEDED)


@query(
    "load_stats",
    sql_with(
        "sales",
        then="""
        SELECT count(*) AS n_records, 13 AS n_columns,
               CAST(CAST(min(start_ts) AS DATE) AS VARCHAR) AS first_date,
               CAST(CAST(max(start_ts) AS DATE) AS VARCHAR) AS last_date,
               count(DISTINCT date_trunc('month', start_ts)) AS n_months FROM sales""",
    ),
)
def stats(spark, folder):
    return load_stats(sales(spark, folder), SALES.start)


@query(
    "load_files",
    "SELECT count(DISTINCT filename) AS n_files, count(*) AS n_records, true AS sized"
    " FROM (SELECT 'lineitem' AS filename FROM lineitem)",
)
def files(spark, folder):
    """The test tables are one file each."""
    stats = file_stats(table(spark, folder, "lineitem"))
    return stats.select("n_files", "n_records", (F.col("size_bytes") > F.col("n_records")).alias("sized"))


# Every column of lineitem, how a reader might expect it, and what that comes to.
_EXPECTED = {
    "l_orderkey": (T.LongType(), "ok"), "l_partkey": (T.LongType(), "ok"), "l_suppkey": (T.LongType(), "ok"),
    "l_linenumber": (T.DoubleType(), "other_type"), "L_Quantity": (T.DoubleType(), "renamed_case"), "l_extendedprice": (T.DoubleType(), "ok"),
    "l_discount": (T.FloatType(), "other_type"), "L_Tax": (T.DoubleType(), "renamed_case"), "l_returnflag": (T.StringType(), "ok"),
    "l_linestatus": (T.StringType(), "ok"), "l_shipdate": (T.DateType(), "other_type"), "airport_fee": (T.DoubleType(), "missing"),
}


@query(
    "schema_drift",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{status}' AS status, {'0' if status == 'missing' else f'count({c})'} AS non_null{'' if status == 'missing' else ' FROM lineitem'}"""
        for c, (_, status) in _EXPECTED.items()
    ),
)
def drift(spark, folder):
    return schema_drift(table(spark, folder, "lineitem"), columns(**{c: dtype for c, (dtype, _) in _EXPECTED.items()}))


@query("dim_zone.csv", sql_with("zones", then=" SELECT * FROM zones"))
def dim_zone_csv(spark, folder):
    """The location table through a CSV file and back."""
    path = shared_folder(spark, "zones")
    zones(spark, folder).write.option("header", True).csv(path)
    return read_zones(spark, path)


_MONTH_FOLDER = r"month=(\d{4}-\d{2})/"
_FOLDER_ORDERS = """
monthly AS (
  SELECT o_orderkey, o_custkey, o_orderdate, date_trunc('month', o_orderdate) AS m, o_orderkey % 97 = 0 AS odd,
         year(o_orderdate) < 1997 OR year(o_orderdate) < 1999 AND o_orderkey % 2 = 0 AS early,
         CASE WHEN year(o_orderdate) < 1997 THEN floor(o_totalprice)
              WHEN year(o_orderdate) < 1999 AND o_orderkey % 2 = 0 THEN o_totalprice
              ELSE CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) END AS total,
         CASE WHEN year(o_orderdate) >= 1997 THEN o_orderpriority END AS priority
  FROM orders)"""


def _write_months(vintage, base: str) -> None:
    """Append the rows to a folder a month; every 97th order goes to one whose name carries no month."""
    named = F.when(F.col("order_key") % 97 == 0, "oddity").otherwise(F.coalesce(F.date_format("ordered", "yyyy-MM"), F.lit("undated")))
    months = vintage.drop("year").withColumn("month", named).hint("rebalance", F.col("month"))
    months.write.mode("append").partitionBy("month").parquet(base)


def _monthly_orders(spark, folder, base: str):
    """Two writers of a folder of monthly files: the first ones, then the later ones. The middle years' months have files of both."""
    old, middle, new = _drifted_orders(spark, folder).values()
    even = F.col("order_key") % 2 == 0
    _write_months(old, base)
    _write_months(middle.filter(even), base)
    yield
    _write_months(middle.filter(~even).withColumn("total", F.col("total").cast("float")), base)
    _write_months(new, base)
    yield


def _order_months(df, period):
    return df.groupBy(period.alias("period")).agg(
        row_count().alias("orders"), F.sum("total").alias("total"), F.count("priority").alias("with_priority"), F.count("customer").alias("with_customer")
    )


_MONTH_FIGURES = "count(*) AS orders, round(sum(total), 2) AS total, count(priority) AS with_priority, count(o_custkey) AS with_customer"


@query(
    "load_folder",
    f"""WITH {_FOLDER_ORDERS}
        SELECT strftime(m, '%Y-%m-%d') AS period, {_MONTH_FIGURES}, true AS left_out FROM monthly WHERE NOT odd AND m IS NOT NULL GROUP BY m""",
    digits=2,
)
def whole_folder(spark, folder):
    """Several files a month, two schemas in one month, and files whose name carries no month."""
    base = shared_folder(spark, "months")
    for _ in _monthly_orders(spark, folder, base):
        pass
    loaded = load_folder(spark, base, schema=_ORDERS, name=_MONTH_FOLDER)
    return _order_months(loaded.df, month_start("ordered")).withColumn("left_out", F.lit(len(loaded.unmatched) > 0))


def _footers(spark, folder):
    base = shared_folder(spark, "months")
    for _ in _monthly_orders(spark, folder, base):
        pass
    return stored(footers(folder_files(spark, base, _MONTH_FOLDER), "ordered"), "footers")


@query(
    "footer_stats",
    f"""WITH {_FOLDER_ORDERS}
        SELECT count(*) AS n_records, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_date,
               CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date,
               count(DISTINCT m) FILTER (WHERE NOT odd) AS n_months, 0 AS n_unread, true AS sized FROM monthly""",
)
def folder_footers(spark, folder):
    stats = footer_stats(_footers(spark, folder))
    sized = (F.col("size_bytes") > 0) & (F.col("n_files") > F.col("n_unmatched")) & (F.col("n_vintages") > 1)
    return stats.select("n_records", "first_date", "last_date", "n_months", "n_unread", sized.alias("sized"))


@query(
    "folder_coverage",
    f"""WITH {_FOLDER_ORDERS}, present AS (SELECT m, count(*) AS rows FROM monthly WHERE NOT odd AND m IS NOT NULL GROUP BY m)
        SELECT CAST(CAST(min(m) AS DATE) AS VARCHAR) AS first_month, CAST(CAST(max(m) AS DATE) AS VARCHAR) AS last_month, count(*) AS months,
               CAST(date_diff('month', min(m), max(m)) + 1 - count(*) AS BIGINT) AS missing_months, CAST(sum(rows) AS BIGINT) AS rows, true AS sized
        FROM present""",
)
def named_months(spark, folder):
    """Coverage by the names and footers of files: nothing is scanned."""
    present = stored(folder_coverage(_footers(spark, folder)), "coverage")
    return coverage_summary(present).withColumns(
        {"rows": present.agg(F.sum("rows")).scalar(), "sized": present.agg(F.sum("bytes") > 0).scalar()}
    )


@query(
    "sync_months",
    f"""WITH {_FOLDER_ORDERS}
        SELECT strftime(m, '%Y-%m') AS period, {_MONTH_FIGURES}, count(DISTINCT early) AS loads
        FROM monthly WHERE NOT odd AND m IS NOT NULL GROUP BY m""",
    digits=2,
)
def incremental_months(spark, folder):
    """A target that follows the folder: one run before and one after the later files come, a third that finds nothing new."""
    base, target = shared_folder(spark, "months"), shared_folder(spark, "synced")
    for _ in _monthly_orders(spark, folder, base):
        sync_months(spark, base, target, schema=_ORDERS, name=_MONTH_FOLDER)
    sync_months(spark, base, target, schema=_ORDERS, name=_MONTH_FOLDER)
    loads = manifest(spark, target).groupBy(F.date_format("month", "yyyy-MM").alias("period")).agg(F.count_distinct("batch").alias("loads"))
    return _order_months(synced(spark, target), F.col("file_month")).join(loads, "period")


@query("dim_zone", sql_with("zones", then=" SELECT * FROM zones"))
def dim_zone(spark, folder):
    return zones(spark, folder)


_MONTHS = "SELECT DISTINCT date_trunc('month', start_ts) AS m FROM sales"


@query(
    "month_coverage",
    sql_with(
        "sales",
        then="""
        SELECT CAST(CAST(date_trunc('month', start_ts) AS DATE) AS VARCHAR) AS period, count(*) AS rows
        FROM sales GROUP BY 1""",
    ),
)
def month_coverage(spark, folder):
    return periods_present(sales(spark, folder, SALES.start), SALES.start)


@query(
    "month_coverage.summary",
    sql_with(
        "sales",
        then=f"""
        SELECT CAST(CAST(min(m) AS DATE) AS VARCHAR) AS first_month,
               CAST(CAST(max(m) AS DATE) AS VARCHAR) AS last_month, count(*) AS months,
               CAST(date_diff('month', min(m), max(m)) + 1 - count(*) AS BIGINT) AS missing_months
        FROM ({_MONTHS})""",
    ),
)
def month_coverage_summary(spark, folder):
    return coverage_summary(periods_present(sales(spark, folder, SALES.start), SALES.start))


@query(
    "month_gaps",
    """WITH present AS (SELECT DISTINCT o_custkey AS customer,
                               CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
            spans AS (SELECT customer, min(m) AS lo, max(m) AS hi FROM present GROUP BY 1),
            every AS (SELECT customer, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
                      FROM spans)
       SELECT customer, CAST(m AS VARCHAR) AS period
       FROM every ANTI JOIN present USING (customer, m)""",
)
def month_gaps(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate")
    return period_gaps(periods_present(orders, "o_orderdate", "month", "customer"), "month", "customer")


@query(
    "day_gaps",
    """WITH present AS (SELECT DISTINCT user_id AS origin_id, CAST(ts AS DATE) AS d FROM events),
            spans AS (SELECT origin_id, min(d) AS lo, max(d) AS hi FROM present GROUP BY 1),
            every AS (SELECT origin_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
                      FROM spans)
       SELECT origin_id, CAST(d AS VARCHAR) AS period
       FROM every ANTI JOIN present USING (origin_id, d)""",
)
def day_gaps(spark, folder):
    facts = rides(spark, folder, "origin_id", "start_ts")
    present = periods_present(facts, RIDES.start, "day", RIDES.origin)
    return period_gaps(present, "day", RIDES.origin)


# The processed columns that both engines sum to compare the written table.
_PROCESSED = ["fare", "distance", "duration_min", "log_distance", "pickup_hour", "is_airport", "zone_7d_avg", "zone_prev_day_avg"]


@query(
    "write_roundtrip",
    sql_with(
        "rides",
        "rides_d",
        then=HISTORY_SQL
        + FILLED_SQL
        + """
        SELECT CASE WHEN start_date < d THEN 'train' ELSE 'test' END AS part,
               CAST(CAST(date_trunc('month', start_date) AS DATE) AS VARCHAR) AS month,
               count(*) AS rows, 21 AS n_columns, round(sum(fare), 2) AS fare, round(sum(distance), 2) AS distance,
               round(sum(duration_min), 2) AS duration_min, round(sum(ln(1 + distance)), 2) AS log_distance,
               CAST(sum(hour(start_ts)) AS BIGINT) AS pickup_hour,
               CAST(count(*) FILTER (WHERE origin_id IN (1, 13, 18) OR dest_id IN (1, 13, 18)) AS BIGINT) AS is_airport,
               round(sum(coalesce(zone_7d_avg, week)), 2) AS zone_7d_avg,
               round(sum(coalesce(zone_prev_day_avg, prev)), 2) AS zone_prev_day_avg
        FROM joined, cut, means WHERE start_date IS NOT NULL GROUP BY 1, 2""",
    ),
    digits=2,
)
def write_roundtrip(spark, folder):
    """The processed train and test tables, written by (part, month) in one go and read back by part."""
    path = f"{shared_folder(spark, 'processed')}/features"
    write_processed(rides(spark, folder), RIDES, path)
    sums = [F.sum(c).alias(c) for c in _PROCESSED]

    def summary(part: str):
        back = spark.read.parquet(path).filter(F.col("part") == part)
        kept = [c for c in back.columns if c not in ("part", "month")]
        return back.groupBy("part", "month").agg(row_count().alias("rows"), F.lit(len(kept)).alias("n_columns"), *sums)

    return summary("train").unionByName(summary("test"))
