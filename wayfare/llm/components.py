"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node of the component.

    Each round shuffles edges by node, takes minima with partial aggregation and stores the result, so no
    node's neighbours are gathered anywhere and a lost executor costs one round at most. Loops and
    repeated edges do no harm. The driver sees one count and one hash sum a round.
    """
    a, b = F.col("a"), F.col("b")
    held = stored(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _fingerprint(held)
    while True:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(smallest, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        lowest = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
        moved = large.join(lowest, F.col("u") == F.col("of")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = stored(moved.union(lowest.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        after = _fingerprint(held)
        if after == before:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
