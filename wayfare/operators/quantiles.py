"""Exact quantiles in two scans, bracketed by mergeable sketches.

The built-in exact ``percentile`` holds every distinct value in one reducer and ``percentile_approx`` returns an
estimate. Here the first scan makes a KLL sketch of each column, together with its moments and any counts asked for. Sketches merge
in two levels, so that no reducer meets those of all tasks. A sketch gives each quantile a bracket that holds its rank. The
second scan counts: values outside the brackets by the gap they fall in, values inside one by one, which is a small
share of the rows. Ranks are then read off those counts: bins of a bracket first, then the values of the bins wanted.

A bracket is ``MARGIN`` times the sketch's error bound (at 99 % confidence) wide on either side. Should a rank lie outside, with a chance
of about 1e-13, both scans are made again with other sketches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored

SKETCH_SIZE = 4096
MARGIN = 3
# First-level groups in which the sketches of all tasks merge.
SALTS = 64
BINS = 1024


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The sketch's error bound as a share of the rows, at 99 % confidence."""
    return 2.296 / size**0.9021


class FirstScan(NamedTuple):
    """What one scan tells of some columns: a stored row with a struct a column and a count a condition."""

    columns: list[str]
    row: DataFrame
    size: int

    def moments(self, column: str) -> Column:
        return F.col(f"c{self.columns.index(column)}")


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def _total(parts: Column, value) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda done, x: done + value(x))


def first_scan(df: DataFrame, columns: list[str], conditions: dict[str, Column] | None = None, size: int = SKETCH_SIZE) -> FirstScan:
    """Scan once: per column n, mean, sample stddev, min, max, finite extent and sketch; per condition how many rows meet it.

    Means and deviations are NaN if a value is; NULL counts nowhere. Sketches leave NaN out.
    """
    conditions = conditions or {}
    kept = [_number(c).alias(f"v{i}") for i, c in enumerate(columns)]
    asked = [condition.alias(f"w{i}") for i, condition in enumerate(conditions.values())]
    salted = df.select(*kept, *asked, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    measures = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        finite = F.when(F.abs(v) < F.lit(float("inf")), v)
        spread = F.var_pop(v) * F.count(v)
        part = F.struct(
            F.count(v).alias("n"), F.avg(v).alias("mean"), spread.alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.min(finite).alias("least"), F.max(finite).alias("most"), F.count(F.when(~F.isnan(v), v)).alias("ranked"),
        )
        measures += [part.alias(f"p{i}"), F.kll_sketch_agg_double(F.when(~F.isnan(v), v), size).alias(f"s{i}")]
    counts = [F.count_if(f"w{i}").alias(f"w{i}") for i in range(len(conditions))]
    salts = salted.groupBy("salt").agg(F.count(F.lit(1)).alias("rows"), *measures, *counts)
    held = salts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.filter(F.collect_list(f"p{i}"), lambda x: x["n"] > 0).alias(f"p{i}") for i in range(len(columns))],  # SALTS at most
        *[F.kll_merge_agg_double(f"s{i}", size).alias(f"s{i}") for i in range(len(columns))],
        *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(name) for i, name in enumerate(conditions)],
    )
    structs = []
    for i in range(len(columns)):
        parts = F.col(f"p{i}")
        n = _total(parts, lambda x: x["n"])
        mean = F.when(n > 0, _total(parts, lambda x: x["n"] * x["mean"]) / n)
        means = F.transform(parts, lambda x: F.struct(x["n"].alias("n"), x["m2"].alias("m2"), (x["mean"] - mean).alias("off")))
        spread = _total(means, lambda x: x["m2"] + x["n"] * x["off"] * x["off"])
        structs.append(
            F.struct(
                n.cast("long").alias("count"), mean.alias("mean"), F.when(n > 1, F.sqrt(spread / (n - 1))).alias("stddev"),
                F.array_min(F.transform(parts, lambda x: x["min"])).alias("min"), F.array_max(F.transform(parts, lambda x: x["max"])).alias("max"),
                F.array_min(F.transform(parts, lambda x: x["least"])).alias("least"), F.array_max(F.transform(parts, lambda x: x["most"])).alias("most"),
                F.aggregate(parts, F.lit(0).cast("long"), lambda done, x: done + x["ranked"]).alias("ranked"), F.col(f"s{i}").alias("sketch"),
            ).alias(f"c{i}")
        )
    return FirstScan(list(columns), stored(held.select("rows", *structs, *conditions), "first-scan"), size)


def sketched_quantiles(scan: FirstScan, probs: list[float]) -> DataFrame:
    """(column, prob, value) estimated from the sketches alone: ranks are off by ``rank_error`` of the rows at most, at 99 % confidence."""
    rows = []
    for name in scan.columns:
        own = scan.moments(name)
        asked = F.array(*map(F.lit, probs))
        pairs = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double(own["sketch"], asked).alias("value"))
        values = F.when(own["ranked"] > 0, F.transform(pairs, lambda x: F.struct(x["prob"].alias("prob"), x["value"].alias("value"))))
        rows.append(F.struct(F.lit(name).alias("column"), values.alias("found")))
    return scan.row.select(F.inline(F.array(*rows))).select("column", F.inline("found"))


class Bracket(NamedTuple):
    low: float
    high: float


def _brackets(scan: FirstScan, probs: list[float]) -> tuple[list[list[Bracket]], list[Row]]:
    """For each column the brackets of its quantiles, ascending; and each column's extent. One row comes to the driver."""
    measured = [F.struct(scan.moments(c)["least"].alias("least"), scan.moments(c)["most"].alias("most"), scan.moments(c)["ranked"].alias("n")) for c in scan.columns]
    extents = list(scan.row.select(*[m.alias(f"c{i}") for i, m in enumerate(measured)]).first())
    edges, asked = [], []
    for name, extent in zip(scan.columns, extents):
        # two rows more, for a quantile's neighbours in small tables
        reach = MARGIN * rank_error(scan.size) + 2 / max(extent["n"], 1)
        edges.append([(max(0.0, p - reach), min(1.0, p + reach)) for p in sorted(probs)] if extent["n"] else [])
        ranks = F.array(*[F.lit(e) for pair in edges[-1] for e in pair])
        asked.append(F.kll_sketch_get_quantile_double(scan.moments(name)["sketch"], ranks) if edges[-1] else F.lit(None))
    found = scan.row.select(*[x.alias(f"c{i}") for i, x in enumerate(asked)]).first()
    out = []
    for values, own in zip(found, edges):
        # a bracket that reaches an end is open there
        ends = [(values[2 * k], values[2 * k + 1]) for k in range(len(own))]
        out.append([Bracket(-math.inf if lo <= 0 else low, math.inf if hi >= 1 else high) for (lo, hi), (low, high) in zip(own, ends)])
    return out, extents


def _inside(v: Column, brackets: list[Bracket]) -> Column:
    inside = F.lit(False)
    for b in brackets:
        inside = inside | v.between(F.lit(b.low), F.lit(b.high))
    return inside


def _gap(v: Column, brackets: list[Bracket]) -> Column:
    """How many brackets end below ``v``; for a value inside one, the number of the first that holds it."""
    gap = F.lit(0)
    for b in brackets:
        gap = gap + F.when(v > F.lit(b.high), 1).otherwise(0)
    return gap


def _bin(v: Column, brackets: list[Bracket], extent: Row) -> Column:
    """The place of an inside value among equal-width bins of its bracket; infinities have bins of their own."""
    out = F.lit(0)
    for k, b in enumerate(brackets):
        low, high = max(b.low, extent["least"]) if extent["least"] is not None else 0.0, min(b.high, extent["most"]) if extent["most"] is not None else 0.0
        width = high / 2 - low / 2  # halved: the difference of two doubles may be no double
        if width > 0 and math.isfinite(width):
            place = F.floor((v / 2 - F.lit(low / 2)) / F.lit(width) * BINS).cast("int")
            finite = F.least(F.greatest(place, F.lit(0)), F.lit(BINS))
            out = F.when(_gap(v, brackets) == k, F.when(v == float("-inf"), -1).when(v == float("inf"), BINS + 1).otherwise(finite)).otherwise(out)
        else:
            out = F.when(_gap(v, brackets) == k, F.when(v == float("-inf"), -1).when(v == float("inf"), BINS + 1).otherwise(0)).otherwise(out)
    return out


def _wanted(n: int, probs: list[float]) -> list[int]:
    """The 0-based ranks on either side of each quantile's position."""
    return sorted({edge(p * (n - 1)) for p in probs for edge in (math.floor, math.ceil)}) if n else []


def quantiles_of(df: DataFrame, scan: FirstScan, probs: list[float], attempts: int = 3) -> DataFrame:
    """(column, prob, value) of ``df``, of which ``scan`` is the first scan; this makes the second.

    Linear interpolation between neighbouring ranks. NULL and NaN are left out; a column without values yields no rows. Infinities rank as such.
    """
    spark = df.sparkSession
    brackets, extents = _brackets(scan, probs)
    cells = []
    for i, name in enumerate(scan.columns):
        v = _number(name)
        gap, inside = _gap(v, brackets[i]), _inside(v, brackets[i])
        place = F.when(inside, _bin(v, brackets[i], extents[i]))
        cells.append(
            F.struct(F.lit(i).alias("c"), gap.alias("gap"), place.alias("bin"), F.when(inside, v).alias("value"), (v.isNotNull() & ~F.isnan(v)).alias("is"))
        )
    exploded = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("is")
    counts = stored(exploded.groupBy("c", "gap", "bin", "value").agg(F.count(F.lit(1)).alias("rows")), "counts")

    ranks = [(i, r) for i, extent in enumerate(extents) for r in _wanted(extent["n"], probs)]
    wanted = spark.createDataFrame(ranks, "c int, rank long") if ranks else spark.createDataFrame([], "c int, rank long")
    by_bin = counts.groupBy("c", "gap", "bin").agg(F.sum("rows").alias("rows"))
    before = Window.partitionBy("c").orderBy("gap", F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_bin.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    held = placed.join(F.broadcast(wanted), "c").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("rows")))
    found = held.select("c", "gap", "bin", "first", "rank").collect()  # two a quantile at most
    if any(r["bin"] is None for r in found):
        if attempts <= 1:
            raise RuntimeError("a quantile's rank lies outside its bracket")
        return quantiles_of(df, first_scan(df, scan.columns, size=scan.size), probs, attempts - 1)
    ranks_of: dict[tuple, list[int]] = defaultdict(list)
    for r in found:
        ranks_of[r["c"], r["gap"], r["bin"], r["first"]].append(r["rank"])
    bins = spark.createDataFrame([(*at, own) for at, own in ranks_of.items()], "c int, gap int, bin int, first long, ranks array<long>")
    values = counts.join(F.broadcast(bins), ["c", "gap", "bin"])
    ahead = Window.partitionBy("c", "gap", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("first", F.col("first") + F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    mine = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("rows")))
    found = ranked.select("c", "value", F.explode(mine).alias("rank"))
    at = found.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    asked = [
        (i, name, p, math.floor(p * (extents[i]["n"] - 1)), math.ceil(p * (extents[i]["n"] - 1)))
        for i, name in enumerate(scan.columns) if extents[i]["n"] for p in probs
    ]
    table = spark.createDataFrame(asked, "c int, column string, prob double, low long, high long")
    low, high = F.element_at("at", F.col("low")), F.element_at("at", F.col("high"))
    n = F.lit([float(e["n"]) for e in extents])
    part = F.col("prob") * (F.element_at(n, F.col("c") + 1) - 1) - F.col("low")
    value = F.when(low == high, low).otherwise(low + (high - low) * part)
    return table.join(at, "c").select("column", "prob", value.alias("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, value) in two scans, see :func:`quantiles_of`."""
    return quantiles_of(df, first_scan(df, columns), probs)
