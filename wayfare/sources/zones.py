"""Location dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.sources.schemas import ZONES


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV (id, borough, zone, service zone) with a declared schema."""
    return spark.read.schema(ZONES).option("header", True).option("enforceSchema", True).csv(path)
