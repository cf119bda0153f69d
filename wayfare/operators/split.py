"""Time-ordered train/test split and train-only imputation.

Cutoffs and fill values stay inside the plan as scalar subqueries: no cross join is needed to bring a
one-row result to the facts. Rows without a date can be put neither before nor after a cutoff: they are on no
side of a split, and :func:`split_counts` and the feature report count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.aggregates import row_count
from wayfare.roles import START_DATE


def day_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(START_DATE).agg(row_count().alias("trips"))


def split_date(days: DataFrame, test_fraction: float) -> DataFrame:
    """One row: the date at the (1 - fraction) rank of the rows; NULL if all share one day.

    ``days`` is (date, trips), so the unpartitioned window below sees one row per calendar
    day, never the facts. The percentile of *rows* keeps a few stray dates from moving it.
    """
    dated = days.filter(F.col(START_DATE).isNotNull())
    so_far = Window.orderBy(START_DATE)
    ranked = dated.select(
        START_DATE,
        F.sum("trips").over(so_far).alias("seen"),
        F.sum("trips").over(so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    reached = F.col("seen") >= F.lit(1.0 - test_fraction) * F.col("all")
    spans_days = F.min(START_DATE) < F.max(START_DATE)
    cut = F.min(F.when(reached, F.col(START_DATE)))
    return ranked.agg(F.when(spans_days, cut).alias("split_date"))


def is_train(cutoff: Column) -> Column:
    """True before the cutoff; without a cutoff every dated row trains."""
    return (F.col(START_DATE) < cutoff) | (cutoff.isNull() & F.col(START_DATE).isNotNull())


def is_test(cutoff: Column) -> Column:
    return F.col(START_DATE) >= cutoff


def part_of(train: Column, test: Column) -> Column:
    """'train', 'test', 'undated', or NULL for a dated row on neither side."""
    sided = F.when(train, "train").when(test, "test")
    return sided.when(F.col(START_DATE).isNull(), "undated")


def split_counts(df: DataFrame, train: Column, test: Column) -> DataFrame:
    """(part, rows, first, last) of each side and of the undated rows, in one pass."""
    parted = df.withColumn("part", part_of(train, test)).filter(F.col("part").isNotNull())
    return parted.groupBy("part").agg(
        row_count().alias("rows"), F.min(START_DATE).alias("first"), F.max(START_DATE).alias("last")
    )


def split_at(df: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(is_train(cutoff)), df.filter(is_test(cutoff))


def time_split(df: DataFrame, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    """(past, future): about the last ``test_fraction`` of the rows are the future."""
    return split_at(df, split_date(day_counts(df), test_fraction).scalar())


def resolved_split(df: DataFrame, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    """:func:`time_split` with the cutoff computed now, as a plain date.

    For eager callers such as model fitting, which would otherwise recompute the cutoff
    in every pass. One date travels to the driver; the filters become constants that
    reach the scan.
    """
    cutoff = split_date(day_counts(df), test_fraction).first()["split_date"]
    return split_at(df, F.lit(cutoff).cast("date"))


def fixed_split(df: DataFrame, first_test_day: str) -> tuple[DataFrame, DataFrame]:
    return split_at(df, F.lit(first_test_day).cast("date"))


def within(first: str, last: str) -> Column:
    return F.col(START_DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def period_split(
    df: DataFrame, train: tuple[str, str], test: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Two date ranges, both ends inclusive; rows in neither are left out."""
    return df.filter(within(*train)), df.filter(within(*test))


def column_means(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of training means; 0.0 where the training part has no value at all."""
    return train.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def fill_with(df: DataFrame, means: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULLs from a one-row frame of means."""
    packed = means.select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), packed.getField(c)) for c in columns})


def impute_from_train(
    train: DataFrame, test: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    means = column_means(train, columns)
    return fill_with(train, means, columns), fill_with(test, means, columns)
