"""Places of rows in a total order, counted without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored

_PART = 33  # monotonically_increasing_id holds the partition above this bit


def ranked(rows: DataFrame, groups: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """``rows`` with ``out``, each row's place from 0 among those equal on ``groups``, by ``order`` (NULL first).

    The rows are sorted by range over all partitions and stored, so a group holding most of them is dealt to many tasks;
    a window then adds up, per group, one count for each partition that it reaches into. Rows equal on ``groups`` and ``order``
    must not differ in what is read of them later. ``rows`` is computed twice: store it first where that is dear.
    """
    sort = [*groups, *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    held = stored(placed, "ranked").withColumn("__part", F.shiftright("__at", _PART))
    parts = held.groupBy(*groups, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    same = F.col("r.__part") == F.col("b.__part")
    for name in groups:
        same = same & F.col(f"r.{name}").eqNullSafe(F.col(f"b.{name}"))
    rank = F.col("b.__before") + F.col("r.__at") - F.col("b.__first")
    return held.alias("r").join(before.alias("b"), same).select(*[F.col(f"r.{c}") for c in rows.columns], rank.alias(out))
