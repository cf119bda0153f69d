"""Distinct counts that add up: one sketch a period, stored, and united without rereading the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_SIZE = 14


def relative_error(lg_size: int = LG_SIZE) -> float:
    """The standard error of an estimate, as a share of the count."""
    return 1.04 / math.sqrt(1 << lg_size)


def period_sketches(df: DataFrame, columns: list[str], period: Column, lg_size: int = LG_SIZE) -> DataFrame:
    """(period, column, rows, sketch): a HyperLogLog sketch of each column's values in each period, NULL not counted.

    Values enter by a 64-bit hash, whatever their type; sketches combine before the shuffle. Store the result, append new periods' to
    it, and unite any of them by :func:`united_distinct`.
    """
    hashed = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias(f"h{i}") for i, c in enumerate(columns)]
    sketches = [F.struct(F.lit(c).alias("column"), F.hll_sketch_agg(f"h{i}", lg_size).alias("sketch")) for i, c in enumerate(columns)]
    by_period = df.select(period.alias("period"), *hashed).groupBy("period").agg(F.count(F.lit(1)).alias("rows"), F.array(*sketches).alias("found"))
    return by_period.select("period", "rows", F.inline("found")).select("period", "column", "rows", "sketch")


def united_distinct(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, column, rows, distinct_values): estimates over all periods of ``sketches``, by ``keys`` if given. A period that comes twice changes
    ``rows`` alone."""
    united = sketches.groupBy(*keys, "column").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    return united.select(*keys, "column", "rows", F.hll_sketch_estimate("sketch").alias("distinct_values"))
