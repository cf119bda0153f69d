"""The few aggregate shapes every analysis is built from.

All combine map-side, so a hot group reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def group_by(df: DataFrame, key: Column, name: str, **measures: Column) -> DataFrame:
    """One row per key value, ordered by key."""
    return (
        df.groupBy(key.alias(name))
        .agg(*[m.alias(alias) for alias, m in measures.items()])
        .orderBy(name)
    )


def relabel(frame: DataFrame, name: str, label: Column, label_name: str) -> DataFrame:
    """Replace the key of an ordered frame by its label; the projection keeps the order."""
    return frame.select(label.alias(label_name), *[c for c in frame.columns if c != name])


def summary(frame: DataFrame, **measures: Column) -> DataFrame:
    return frame.agg(*[m.alias(alias) for alias, m in measures.items()])


def peak(key: str, count: str) -> Column:
    """Key of the largest count; the smallest such key on a tie."""
    return F.min_by(F.col(key), F.struct(-F.col(count), F.col(key)))


def top_k(frame: DataFrame, count: str, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` largest; runs as a per-task heap, not a full sort."""
    return frame.orderBy(F.desc(count), tiebreak).limit(k)
