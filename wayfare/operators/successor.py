"""Next timestamp per key without one giant window group.

``lead(ts) OVER (PARTITION BY key ...)`` sorts all rows of a key in one task; a key
holding a third of a large table never finishes. Here the rows are windowed per
(key, time bucket). Only the last row of a bucket lacks its successor, and that one
is the first timestamp of the key's next non-empty bucket: a lookup in a table of
at most one row per key and bucket, pre-aggregated before its shuffle. The join keys
equal the window's partitioning, so the fact rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_successor(
    df: DataFrame, key: str, ts: str, tiebreak: str, out: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Add ``out``: the key's next ``ts`` in (ts, tiebreak) order.

    NULL for a key's last row and for rows without a key, which follow nobody.
    """
    bucket, following = "__bucket", "__following"
    bucketed = df.withColumn(bucket, F.floor(F.unix_timestamp(ts) / F.lit(bucket_seconds)))
    inside = Window.partitionBy(key, bucket).orderBy(ts, tiebreak)

    firsts = bucketed.groupBy(key, bucket).agg(F.min(ts).alias(following))
    per_key = Window.partitionBy(key).orderBy(bucket)
    next_first = firsts.select(key, bucket, F.lead(following).over(per_key).alias(following))

    return (
        bucketed.withColumn(out, F.lead(ts).over(inside))
        .join(next_first, [key, bucket], "left")
        .withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce(out, following)))
        .drop(bucket, following)
    )
