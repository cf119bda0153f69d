"""Which calendar periods a fact table covers, and the holes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.timeparts import month_start
from wayfare.operators.aggregates import row_count

_STEP = {"month": "interval 1 month", "day": "interval 1 day"}


def periods_present(df: DataFrame, start: str, unit: str = "month", *keys: str) -> DataFrame:
    """(keys, period, rows): one row per calendar period that has data."""
    period = month_start(start) if unit == "month" else F.to_date(start)
    return (
        df.filter(F.col(start).isNotNull())
        .groupBy(*keys, period.alias("period"))
        .agg(row_count().alias("rows"))
    )


def period_gaps(present: DataFrame, unit: str = "month", *keys: str) -> DataFrame:
    """(keys, period): periods strictly inside the covered span that have no data.

    Holes are read off consecutive present periods, so there is no calendar to join.
    The window runs on the aggregate: its size is the number of periods per key.
    """
    step = F.expr(_STEP[unit])
    following = F.lead("period").over(Window.partitionBy(*keys).orderBy("period"))
    first_hole = F.to_date(F.col("period") + step)
    last_hole = F.to_date(F.col("following") - step)
    return (
        present.select(*keys, "period")
        .withColumn("following", following)
        .filter(first_hole <= last_hole)
        .select(*keys, F.explode(F.sequence(first_hole, last_hole, step)).alias("period"))
    )


def coverage_summary(present: DataFrame) -> DataFrame:
    """One row: first and last month, months with data, months missing in between."""
    span = F.months_between("last_month", "first_month").cast("int") + 1
    return (
        present.agg(
            F.min("period").alias("first_month"),
            F.max("period").alias("last_month"),
            row_count().alias("months"),
        )
        .withColumn("missing_months", (span - F.col("months")).cast("bigint"))
    )
