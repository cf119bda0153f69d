"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.catalog.cleaning import derived_rides
from wayfare.catalog.registry import RIDES_KEEP, query, sql_with
from wayfare.functions.timeparts import month_start
from wayfare.operators.cleaning import standard_rules, with_derived
from wayfare.operators.distinct import period_sketches, relative_error, united_distinct
from wayfare.operators.quality import (
    categorical_distribution,
    clipped_histogram,
    column_profile,
    distinct_counts,
    duplicate_rows,
    duplicate_rows_approx,
    missing_per_column,
    numeric_summary,
    sanity_block,
    target_audit,
)
from wayfare.operators.quantiles import MARGIN, exact_quantiles, rank_error
from wayfare.operators.report import quality_report
from wayfare.roles import DURATION, START_DATE
from wayfare.sources.sinks import shared_folder
from wayfare.sources.tables import RIDE_COLUMNS, RIDES, RIDES_LIMITS, SALE_COLUMNS, SALES, SALES_LIMITS, rides, sales, table


def _missing(column: str) -> str:
    return f"SELECT '{column}' AS c, count(*) - count({column}) AS missing, count(*) AS n FROM rides"


@query(
    "missing_per_column",
    sql_with(
        "rides",
        then=f""" SELECT c AS "column", missing, round(missing / n * 100, 6) AS missing_pct
                  FROM ({' UNION ALL '.join(map(_missing, RIDE_COLUMNS))}) WHERE missing > 0""",
    ),
)
def missing(spark, folder):
    return missing_per_column(rides(spark, folder))


def _check(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS c, count(*) FILTER (WHERE {condition}) AS k, count(*) AS n FROM rides_d"


_CHECKS = " UNION ALL ".join(
    [
        _check("implausible_fare", "fare <= 0 OR fare > 250"),
        _check("zero_distance", "distance <= 0"),
        _check("extreme_distance", "distance >= 100"),
        _check("bad_passenger_count", "party IS NULL OR party <= 0"),
        _check("bad_duration", "duration_min < 1 OR duration_min > 180"),
    ]
)


@query(
    "sanity_block",
    sql_with(
        "rides",
        "rides_d",
        then=f' SELECT c AS "check", k AS rows, round(k / n * 100, 6) AS pct FROM ({_CHECKS})',
    ),
)
def sanity(spark, folder):
    return sanity_block(derived_rides(spark, folder), RIDES, RIDES_LIMITS)


_DUPLICATES = """
  SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows,
         CAST(sum(n - 1) AS BIGINT) AS duplicates
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY {columns})"""


@query("duplicate_rows", _DUPLICATES.format(columns="l_orderkey, l_linenumber"))
def duplicate_lines(spark, folder):
    return duplicate_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))


_LINE_COLUMNS = """
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate"""


@query("duplicate_rows.full", _DUPLICATES.format(columns=_LINE_COLUMNS))
def duplicate_full_lines(spark, folder):
    return duplicate_rows(table(spark, folder, "lineitem"), compare_rows=True)


@query("duplicate_rows.fingerprint", _DUPLICATES.format(columns=_LINE_COLUMNS))
def duplicate_fingerprints(spark, folder):
    return duplicate_rows(table(spark, folder, "lineitem"))


@query(
    "duplicate_rows_approx",
    """SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_rows, true AS within_bound
       FROM lineitem""",
)
def duplicate_estimate(spark, folder):
    """The estimate against the exact count: within five standard deviations of the sketch."""
    rsd, keys = 0.01, table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    estimate = duplicate_rows_approx(keys, rsd).select("rows", "approx_distinct")
    exact = duplicate_rows(keys).select("distinct_rows").scalar()
    off = F.abs(F.col("approx_distinct") - exact)
    return estimate.select("rows", exact.alias("distinct_rows"), (off <= 5 * rsd * exact).alias("within_bound"))


_NUMERIC = ["fare", "total", "distance", "party", DURATION]


def _statistics(column: str) -> str:
    values = {
        "count": f"CAST(count({column}) AS DOUBLE)",
        "mean": f"avg({column})",
        "stddev": f"stddev_samp({column})",
        "min": f"min({column})",
        "max": f"max({column})",
        "25%": f"quantile_cont({column}, 0.25)",
        "50%": f"quantile_cont({column}, 0.5)",
        "75%": f"quantile_cont({column}, 0.75)",
    }
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{name}' AS statistic, round({sql}, 6) AS value FROM rides_d"
        for name, sql in values.items()
    )


@query(
    "numeric_summary",
    sql_with("rides", "rides_d", then=" " + " UNION ALL ".join(map(_statistics, _NUMERIC))),
)
def summary_exact(spark, folder):
    facts = derived_rides(spark, folder, "start_ts", "end_ts", *_NUMERIC[:-1])
    return numeric_summary(facts, _NUMERIC)


def _within(probs: dict[str, float], columns: list[str], view: str) -> str:
    """Every estimate is as near in rank as the sketch promises."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{q}' AS statistic, true AS within FROM {view} HAVING count({c}) > 0" for c in columns for q in probs)


def _judged(df, columns: list[str], probs: dict[str, float], estimates):
    """(column, statistic, within): whether each estimate lies between the exact quantiles at its rank less and plus the bound."""
    reach = MARGIN * rank_error()
    edges = {q: (max(0.0, p - reach), min(1.0, p + reach)) for q, p in probs.items()}
    exact = exact_quantiles(df, columns, sorted({e for pair in edges.values() for e in pair}))
    bounds = df.sparkSession.createDataFrame([(q, *pair) for q, pair in edges.items()], "statistic string, low double, high double")
    joined = estimates.join(bounds, "statistic")
    for side in ("low", "high"):
        at = exact.select("column", F.col("prob").alias(side), F.col("value").alias(f"{side}_value"))
        joined = joined.join(at, ["column", side])
    return joined.select("column", "statistic", F.col("value").between(F.col("low_value"), F.col("high_value")).alias("within"))


_QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


@query("numeric_summary_approx", sql_with("rides", "rides_d", then=" " + _within(_QUARTILES, _NUMERIC, "rides_d")))
def summary_sketched(spark, folder):
    """The estimated quartiles, each held against exact quantiles on either side of its error bound."""
    facts = derived_rides(spark, folder, "start_ts", "end_ts", *_NUMERIC[:-1])
    estimates = numeric_summary(facts, _NUMERIC, exact=False).filter(F.col("statistic").isin(*_QUARTILES))
    return _judged(facts, _NUMERIC, _QUARTILES, estimates)


_AUDIT = {
    "min": "min(fare)",
    "max": "max(fare)",
    "negative": "CAST(count(*) FILTER (WHERE fare < 0) AS DOUBLE)",
    "above_cap": "CAST(count(*) FILTER (WHERE fare > 100000) AS DOUBLE)",
    "median": "quantile_cont(fare, 0.5)",
    "p99_9": "quantile_cont(fare, 0.999)",
    "p99_99": "quantile_cont(fare, 0.9999)",
}


@query(
    "target_audit",
    sql_with(
        "sales",
        then=" "
        + " UNION ALL ".join(f"SELECT '{m}' AS measure, round({q}, 6) AS value FROM sales" for m, q in _AUDIT.items()),
    ),
)
def audit_exact(spark, folder):
    return target_audit(sales(spark, folder, "fare"), "fare", SALES_LIMITS.fare_max)


_TAIL = {"median": 0.5, "p99_9": 0.999, "p99_99": 0.9999}


@query("target_audit_approx", sql_with("sales", then=" " + _within(_TAIL, ["fare"], "sales")))
def audit_sketched(spark, folder):
    """The estimated tail of the target, held against exact quantiles likewise."""
    facts = sales(spark, folder, "fare")
    found = target_audit(facts, "fare", SALES_LIMITS.fare_max, exact=False).filter(F.col("measure").isin(*_TAIL))
    return _judged(facts, ["fare"], _TAIL, found.select(F.lit("fare").alias("column"), F.col("measure").alias("statistic"), "value"))


_REPORTED = ["distance", "party", "fare", "tip", "total", DURATION]
_SALE_ALL = [*SALE_COLUMNS, DURATION, START_DATE]
_SALE_CHECKS = {
    "implausible_fare": "fare <= 0 OR fare > 100000",
    "zero_distance": "distance <= 0",
    "extreme_distance": "distance >= 45",
    "bad_passenger_count": "party IS NULL OR party <= 0",
    "bad_duration": "duration_min < 1440 OR duration_min > 2592000",
}


def _report_sql() -> str:
    counted = [("missing", c, f"{c} IS NULL") for c in _SALE_ALL] + [("sanity", n, c) for n, c in _SALE_CHECKS.items()]
    rows = "SELECT 'table' AS section, 'all' AS subject, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM sales_d"
    parts = [rows, "SELECT 'table', 'all', 'distinct_rows', CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT * FROM sales_d)"]
    parts.append("SELECT 'table', 'all', 'duplicates', CAST((SELECT count(*) FROM sales_d) - count(*) AS DOUBLE) FROM (SELECT DISTINCT * FROM sales_d)")
    for section, subject, condition in counted:
        hit = f"count(*) FILTER (WHERE {condition})"
        parts.append(f"SELECT '{section}', '{subject}', 'rows', CAST({hit} AS DOUBLE) FROM sales_d")
        parts.append(f"SELECT '{section}', '{subject}', 'pct', round(100.0 * {hit} / count(*), 4) FROM sales_d")
    for c in _REPORTED:
        figures = {"count": f"count({c})", "mean": f"avg({c})", "stddev": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})"}
        parts += [f"SELECT 'numeric', '{c}', '{m}', round(CAST({sql} AS DOUBLE), 4) FROM sales_d" for m, sql in figures.items()]
    return sql_with("sales", "sales_d", then=" " + " UNION ALL ".join(parts))


@query("quality_report", _report_sql(), digits=4)
def whole_report(spark, folder):
    return quality_report(with_derived(sales(spark, folder), SALES), SALES, SALES_LIMITS, _REPORTED)


# Ranges the three histograms are clipped to.
CLIP_RANGES = {"fare": (-20, 300), DURATION: (0, 200), "distance": (0, 60)}


def _histogram(column: str, low: float, high: float) -> str:
    step = (high - low) / 60
    return f"""
      SELECT '{column}' AS "column",
             CAST(least(floor((least(greatest({column}, {low}::DOUBLE), {high}::DOUBLE) - {low}::DOUBLE)
                              / {step!r}::DOUBLE) + 1, 60) AS INTEGER) AS bin,
             count(*) AS before, count(*) FILTER (WHERE {RIDES_KEEP}) AS after
      FROM rides_d WHERE {column} IS NOT NULL GROUP BY 2"""


@query(
    "hist_before_after",
    sql_with(
        "rides",
        "rides_d",
        then=" UNION ALL ".join(_histogram(c, lo, hi) for c, (lo, hi) in CLIP_RANGES.items()),
    ),
)
def histogram(spark, folder):
    facts = derived_rides(spark, folder)
    return clipped_histogram(facts, CLIP_RANGES, standard_rules(RIDES, RIDES_LIMITS))


@query(
    "categorical_dist",
    """SELECT 'event_type' AS "column", event_type AS value, count(*) AS rows FROM events GROUP BY event_type
       UNION ALL
       SELECT 'k', CAST(json_extract_string(props, '$.k') AS VARCHAR), count(*) FROM events GROUP BY 2""",
)
def categories(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return categorical_distribution(events, ["event_type", "k"])


_DISTINCT = ["origin_id", "dest_id", "fare", "rate_code", "party"]


@query(
    "distinct_counts",
    sql_with(
        "rides",
        then=" "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM rides" for c in _DISTINCT
        ),
    ),
)
def distincts(spark, folder):
    return distinct_counts(rides(spark, folder, *_DISTINCT), _DISTINCT)


_SKETCHED = ["origin_id", "dest_id", "order_key", "fare", "flag"]


@query(
    "distinct_counts.sketched",
    sql_with(
        "sales",
        then=" "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS distinct_values, true AS within FROM sales" for c in _SKETCHED
        ),
    ),
)
def united_counts(spark, folder):
    """Sketches of the early months, those of the later ones appended, all united: within five standard errors of the exact counts."""
    facts = sales(spark, folder, "start_ts", *_SKETCHED)
    path, late = shared_folder(spark, "sketches"), F.coalesce(F.year("start_ts") >= 1998, F.lit(False))
    for part in (~late, late):
        period_sketches(facts.filter(part), _SKETCHED, month_start("start_ts")).write.mode("append").parquet(path)
    found = united_distinct(spark.read.parquet(path)).withColumnRenamed("distinct_values", "estimate")
    off = F.abs(F.col("estimate") - F.col("distinct_values"))
    within = off <= F.greatest(F.lit(1.0), 5 * relative_error() * F.col("distinct_values"))
    return found.join(distinct_counts(facts, _SKETCHED), "column").select("column", "rows", "distinct_values", within.alias("within"))


_KINDS = {
    "order_key": "numeric", "line_number": "numeric", "start_ts": "timestamp", "end_ts": "timestamp", "origin_id": "numeric",
    "dest_id": "numeric", "distance": "numeric", "party": "numeric", "rate_code": "numeric", "flag": "categorical", "fare": "numeric",
    "tip": "numeric", "total": "numeric",
}


@query(
    "classify_columns",
    sql_with(
        "sales",
        then=" "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS non_null FROM sales"
            for c, kind in _KINDS.items()
        ),
    ),
)
def classified(spark, folder):
    return column_profile(sales(spark, folder, *_KINDS))
