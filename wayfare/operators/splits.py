"""The exact best split of a regression target, for each feature, without sorting rows.

Rows become counts and sums per distinct value with partial aggregation. Prefix sums over the values run in slices of about equal size, cut where a
first scan's sketches say, so that a feature with as many values as rows is dealt to many tasks; the slices' own totals are summed over the few slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.quantiles import first_scan, sketched_quantiles
from wayfare.sources.sinks import stored

SLICES = 256


def _value_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, value, n, total), NULL and NaN left out on either side."""
    y = F.col(f"`{target}`").cast("double")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"), y.alias("y")) for f in features])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter("value IS NOT NULL AND NOT isnan(value) AND y IS NOT NULL AND NOT isnan(y)")
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


def split_gains(df: DataFrame, features: list[str], target: str, slices: int = SLICES) -> DataFrame:
    """(feature, threshold, n_left, n_right, left_mean, right_mean, gain) of every split between two neighbouring values.

    A row goes left if its value is at most ``threshold``, the middle between the two; ``gain`` is by how much the squared error of the
    two means is less than that of one.
    """
    probs = [k / slices for k in range(1, slices)]
    cuts = sketched_quantiles(first_scan(df, features), probs).groupBy(F.col("column").alias("feature")).agg(F.sort_array(F.collect_set("value")).alias("cuts"))
    counts = _value_counts(df, features, target).join(F.broadcast(cuts), "feature")  # a row a feature, `slices` values each
    placed = counts.withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    held = stored(placed, "value-counts")
    of_slice = held.groupBy("feature", "slice").agg(F.sum("n").alias("slice_n"), F.sum("total").alias("slice_total"), F.min("value").alias("low"))
    order = Window.partitionBy("feature").orderBy("slice")
    earlier, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    offsets = of_slice.select(
        "feature", "slice",
        F.coalesce(F.sum("slice_n").over(earlier), F.lit(0)).alias("before_n"), F.coalesce(F.sum("slice_total").over(earlier), F.lit(0.0)).alias("before_total"),
        F.lead("low").over(order).alias("next_low"), F.sum("slice_n").over(every).alias("all_n"), F.sum("slice_total").over(every).alias("all_total"),
    )
    inside = Window.partitionBy("feature", "slice").orderBy("value")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = held.select(
        "feature", "slice", "value", F.sum("n").over(so_far).alias("own_n"), F.sum("total").over(so_far).alias("own_total"), F.lead("value").over(inside).alias("next")
    )
    joined = summed.join(F.broadcast(offsets), ["feature", "slice"])  # SLICES rows a feature
    n, total = F.col("before_n") + F.col("own_n"), F.col("before_total") + F.col("own_total")
    after = F.coalesce("next", "next_low")
    sides = joined.filter(after.isNotNull()).select(
        "feature", ((F.col("value") + after) / 2).alias("threshold"), n.alias("n_left"), (F.col("all_n") - n).alias("n_right"),
        (total / n).alias("left_mean"), ((F.col("all_total") - total) / (F.col("all_n") - n)).alias("right_mean"), (F.col("all_total") / F.col("all_n")).alias("mean"),
    )
    left, right = F.col("left_mean") - F.col("mean"), F.col("right_mean") - F.col("mean")
    return sides.withColumn("gain", F.col("n_left") * left * left + F.col("n_right") * right * right).drop("mean")


def best_splits(df: DataFrame, features: list[str], target: str, slices: int = SLICES) -> DataFrame:
    """The split of most gain of each feature, of equal ones that with the least threshold. A feature of one value has none."""
    gains = split_gains(df, features, target, slices)
    best = F.max_by(F.struct(*gains.columns[1:]), F.struct("gain", -F.col("threshold"))).alias("best")
    return gains.groupBy("feature").agg(best).select("feature", "best.*")
