"""Data-quality reports, each one aggregate over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.bins import equal_width_bin
from wayfare.operators.cleaning import Rule, keeps_all
from wayfare.operators.quantiles import SKETCH_SIZE, FirstScan, first_scan, quantiles_of, sketched_quantiles
from wayfare.roles import DURATION, Limits, Roles


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def missing_per_column(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) for the columns with any NULL, worst first."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return (
        counts.unpivot("__rows", df.columns, "column", "missing")
        .filter(F.col("missing") > 0)
        .select("column", "missing", percent_of(F.col("missing"), F.col("__rows")).alias("missing_pct"))
        .orderBy(F.desc("missing"), "column")
    )


def sanity_checks(roles: Roles, limits: Limits) -> dict[str, Column]:
    """Gross implausibilities by name.

    These are wider than the cleaning rules: a fare between zero and the minimum and a
    missing fare or distance are removed by cleaning but not counted here.
    """
    fare, distance, party = F.col(roles.fare), F.col(roles.distance), F.col(roles.party)
    minutes = F.col(DURATION)
    return {
        "implausible_fare": implausible(fare, limits.fare_max),
        "zero_distance": distance <= 0,
        "extreme_distance": distance >= limits.distance_max,
        "bad_passenger_count": party.isNull() | (party <= 0),
        "bad_duration": (minutes < limits.duration_min) | (minutes > limits.duration_max),
    }


def sanity_block(df: DataFrame, roles: Roles, limits: Limits) -> DataFrame:
    """(check, rows, pct) of :func:`sanity_checks`."""
    checks = sanity_checks(roles, limits)
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(c).alias(name) for name, c in checks.items()]
    )
    return (
        counts.unpivot("__rows", list(checks), "check", "rows")
        .select("check", "rows", percent_of(F.col("rows"), F.col("__rows")).alias("pct"))
        .orderBy("check")
    )


def implausible(target: Column, maximum: float) -> Column:
    return (target <= 0) | (target > maximum)


def implausible_share(df: DataFrame, target: str, maximum: float) -> DataFrame:
    """One row: rows, rows with a target at or below zero or above the cap, and their share."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(implausible(F.col(target), maximum)).alias("implausible"),
    )
    return counted.withColumn("pct", percent_of(F.col("implausible"), F.col("rows")))


def _row_hash(df: DataFrame, salt: int = 0) -> Column:
    """64-bit hash under which rows that group together are equal.

    Spark's hash skips NULLs, so (1, NULL) and (NULL, 1) would collide; a NULL flag per
    column tells them apart. Adding 0.0 folds -0.0 into 0.0 as grouping does.
    """
    cells = []
    for field in df.schema:
        cell = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            cell = cell + F.lit(0.0)
        cells += [cell.isNull(), cell]
    return F.xxhash64(F.lit(salt), *cells)


def duplicate_rows(df: DataFrame, compare_rows: bool = False) -> DataFrame:
    """One row: rows, distinct rows, surplus copies, from one scan and one shuffle.

    Rows are grouped by two independently salted 64-bit hashes, so 16 bytes per row move
    instead of the row, and a group of copies however large is combined before it does.
    Two given rows that differ share both hashes with probability 2^-128; pass
    ``compare_rows`` to group by the full rows instead and rule even that out.
    """
    if compare_rows:
        copies = df.groupBy(*df.columns)
    else:
        copies = df.groupBy(_row_hash(df, 1).alias("__h1"), _row_hash(df, 2).alias("__h2"))
    return copies.agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
    )


def duplicate_rows_approx(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """The one-scan HyperLogLog estimate; off by about ``rsd`` times the row count."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct(_row_hash(df), rsd).alias("approx_distinct"),
    )
    surplus = F.greatest(F.lit(0), F.col("rows") - F.col("approx_distinct"))
    return counted.withColumn("approx_duplicates", surplus)


_MOMENTS = ["count", "mean", "stddev", "min", "max"]
_QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def _named_quantiles(df: DataFrame, scan: FirstScan, probs: dict[str, float], out: str, exact: bool) -> DataFrame:
    """(column, out, value) of quantiles under their names."""
    found = quantiles_of(df, scan, list(probs.values())) if exact else sketched_quantiles(scan, list(probs.values()))
    names = F.coalesce(*[F.when(F.col("prob") == p, F.lit(name)) for name, p in probs.items()])
    return found.select("column", names.alias(out), "value")


def numeric_summary(df: DataFrame, columns: list[str], exact: bool = True, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """(column, statistic, value): count, mean, sample stddev, min, quartiles, max, in two scans.

    The first scan gives all but the quartiles and brackets those for the second, see :mod:`~wayfare.operators.quantiles`. With
    ``exact=False`` the sketches of the first answer for them.
    """
    scan = first_scan(df, columns, size=sketch_size)
    packed = scan.row.select(
        *[F.struct(*[scan.moments(c)[m].cast("double").alias(m) for m in _MOMENTS]).alias(c) for c in columns]
    )
    moments = packed.unpivot([], columns, "column", "__s").select("column", "__s.*").unpivot(["column"], _MOMENTS, "statistic", "value")
    return moments.unionByName(_named_quantiles(df, scan, _QUARTILES, "statistic", exact))


_AUDIT_QUANTILES = {"median": 0.5, "p99_9": 0.999, "p99_99": 0.9999}


def target_audit(df: DataFrame, target: str, cap: float, exact: bool = True, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """(measure, value): range, median, far tail, negatives and rows above the cap; scanned as by :func:`numeric_summary`."""
    y = F.col(target).cast("double")
    scan = first_scan(df, [target], {"negative": y < 0, "above_cap": y > cap}, sketch_size)
    own = scan.moments(target)
    measures = {"min": own["min"], "max": own["max"], "negative": F.col("negative").cast("double"), "above_cap": F.col("above_cap").cast("double")}
    one_row = scan.row.select(*[c.alias(name) for name, c in measures.items()])
    tail = _named_quantiles(df, scan, _AUDIT_QUANTILES, "measure", exact)
    return one_row.unpivot([], list(measures), "measure", "value").unionByName(tail.drop("column"))


def clipped_histogram(
    df: DataFrame, ranges: dict[str, tuple[float, float]], rules: list[Rule], bins: int = 60
) -> DataFrame:
    """(column, bin, before, after): all rows, before and after cleaning, in one scan."""
    binned = df.select(
        keeps_all(rules).alias("kept"),
        *[equal_width_bin(F.col(c), lo, hi, bins).alias(c) for c, (lo, hi) in ranges.items()],
    )
    return (
        binned.unpivot("kept", list(ranges), "column", "bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("before"), F.count_if("kept").alias("after"))
        .orderBy("column", "bin")
    )


def categorical_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows) for low-cardinality columns, most frequent first."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("column", F.desc("rows"), "value")
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values), NULL not counted.

    Spark first groups by (column, value), so hot values are absorbed map-side.
    """
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "distinct_values").orderBy("column")


def classify_columns(df: DataFrame) -> dict[str, str]:
    """Column name -> categorical, numeric, timestamp or other, from the schema alone."""

    def kind(dtype: T.DataType) -> str:
        if isinstance(dtype, T.StringType):
            return "categorical"
        if isinstance(dtype, T.NumericType):
            return "numeric"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "timestamp"
        return "other"

    return {f.name: kind(f.dataType) for f in df.schema}


def column_profile(df: DataFrame) -> DataFrame:
    """(column, kind, non_null) for every column in one aggregate."""
    kinds = classify_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    labelled = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return (
        counts.unpivot([], df.columns, "column", "non_null")
        .select("column", F.element_at(labelled, F.col("column")).alias("kind"), "non_null")
        .orderBy("column")
    )
