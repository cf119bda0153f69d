"""Join rows to a table that is unique on the key, when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot if it has more than one in so many rows; there are fewer hot keys than that.
HOT_SHARE = 1000


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "rows") -> DataFrame:
    """``rows`` inner joined to ``table``, which is unique on ``keys`` and has in ``count`` how many rows each key has.

    Keys with more than a ``HOT_SHARE``-th of all counted rows, fewer than ``HOT_SHARE`` whatever the size, meet their rows by broadcast,
    where these are; the others, none of which makes up much of a task, by shuffle. Keys must not be NULL. ``rows`` is
    read twice, ``table`` three times; ``count`` is not in the result.
    """
    limit = table.agg(F.coalesce(F.sum(count), F.lit(0)) / HOT_SHARE).scalar()
    hot = table.filter(F.col(count) > limit)
    cold = table.filter(F.col(count) <= limit).drop(count)
    spread = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot.drop(count)), keys).unionByName(spread)
