"""Regression quality as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.bins import equal_width_bin
from wayfare.functions.sampling import first_by_hash
from wayfare.operators.aggregates import row_count

PREDICTION = "prediction"


def error(label: str) -> Column:
    return F.col(PREDICTION) - F.col(label)


def regression_metrics(scored: DataFrame, label: str) -> DataFrame:
    """One row (n, rmse, mae, r2) from a single pass.

    R2 is 1 - mean squared error / variance of the label; Spark's variance merges partial
    moments, so it does not lose digits the way sum(y*y) - n*mean^2 would.
    """
    squared = F.avg(error(label) * error(label))
    spread = F.var_pop(F.col(label))
    return scored.agg(
        row_count().alias("n"),
        F.sqrt(squared).alias("rmse"),
        F.avg(F.abs(error(label))).alias("mae"),
        F.when(spread > 0, 1.0 - squared / spread).alias("r2"),
    )


def prediction_sample(scored: DataFrame, label: str, *keys: str, rows: int = 200) -> DataFrame:
    """(actual, predicted, error) of ``rows`` rows chosen by key hash."""
    return first_by_hash(scored, rows, *keys).select(
        *keys,
        F.col(label).alias("actual"),
        F.col(PREDICTION).alias("predicted"),
        error(label).alias("error"),
    )


def residual_histogram(
    scored: DataFrame, label: str, low: float, high: float, bins: int = 40
) -> DataFrame:
    """(bin, rows) of prediction - actual, clipped to ``[low, high]``."""
    residual = equal_width_bin(error(label), low, high, bins)
    return (
        scored.select(residual.alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(row_count().alias("rows"))
        .orderBy("bin")
    )
