"""Second-order gradient boosting of regression trees over binned features, by distributed histograms.

1. One scan's sketches cut each feature into at most ``bins`` bins; rows become a byte a feature, their label and their margin (the prediction so far), and are
   stored.
2. A level of a tree is one pass: tasks add up gradients and hessians by (node, feature, bin), the sums combine by partial aggregation, and the driver gets one
   row for each of at most nodes x features x bins combinations, which no number of rows makes more. It takes the split of most regularised gain of each node,
   trying rows without the feature's value on either side.
3. Margins are brought up to date in a new stored table every ``_STORED_EVERY`` trees; in between, a pass adds the few trees since.
4. Rows marked for validation are left out of the histograms; their error is measured by the first pass of each round, and rounds end when it has
   not improved for ``patience`` of them. The trees up to the best round are kept.

The loss is the squared error: gradient margin - label, hessian 1. NULL and NaN features are a bin of their own. Rows with a NULL or NaN label are left out of the fit.
Sketches draw at random, so a feature of many distinct values may be cut a little differently from run to run; one whose values all get a bin is not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.evaluation import PREDICTION
from wayfare.operators.quantiles import first_scan, sketched_quantiles
from wayfare.shipping import ship_package
from wayfare.sources.sinks import stored

_MISSING = 255
_STORED_EVERY = 5
_ROWS = "bins binary, label double, draw double, validates boolean, margin double"


@dataclass(frozen=True)
class Settings:
    """The defaults."""

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    bins: int = 64
    patience: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2i + 1 and 2i + 2. A node without a feature is a leaf."""

    feature: list[int]
    threshold: list[int]  # bins up to it go left
    missing_left: list[bool]
    value: list[float]

    @staticmethod
    def root(depth: int) -> Tree:
        size = (1 << depth + 1) - 1
        return Tree([-1] * size, [0] * size, [True] * size, [0.0] * size)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row of ``bins`` ends."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.missing_left)
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            own = bins[inner, feature[at]]
            goes_left = np.where(own == _MISSING, left[at], own <= threshold[at])
            node[inner] = 2 * at + 2 - goes_left


@dataclass
class BoostedTrees:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """(row, feature) bins of the features' values, NaN for missing."""
        out = np.full((len(columns[0]) if columns else 0, len(self.features)), _MISSING, np.uint8)
        for f, (values, cuts) in enumerate(zip(columns, self.cuts)):
            present = ~np.isnan(values)
            out[present, f] = np.searchsorted(np.array(cuts), values[present], side="left")
        return out

    def margins(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees if trees is None else trees:
            total += np.array(tree.value)[tree.leaves(bins)]
        return total

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "cuts": self.cuts, "base": self.base, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        held = json.loads(text)
        return BoostedTrees(held["features"], held["cuts"], held["base"], [Tree(**t) for t in held["trees"]])


def _numbers(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)]


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """(row, feature) bins: the values' bytes as they lie in Arrow's buffer, ``width`` a row."""
    column = batch.column(0)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8, len(column) * width, column.offset * width).reshape(-1, width)


def _prepared(df: DataFrame, model: BoostedTrees, label: Column, validates: Column, settings: Settings) -> DataFrame:
    """The stored table of binned rows."""
    width = len(model.features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(_columns(batch, width))
            margin = pa.array(np.full(batch.num_rows, model.base))
            rows = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.record_batch([rows, *batch.columns[width:], margin], names=["bins", "label", "draw", "validates", "margin"])

    values = _numbers(model.features)
    drawn = F.xxhash64(F.lit(settings.seed), label, *[F.col(f"`{f}`") for f in model.features])
    draw = F.pmod(drawn, F.lit(1 << 40)) / float(1 << 40)
    narrow = df.select(*values, label.alias("label"), draw.alias("draw"), F.coalesce(validates, F.lit(False)).alias("validates"))
    return stored(narrow.filter("label IS NOT NULL AND NOT isnan(label)").mapInArrow(pack, _ROWS), "boosting")


def _moved(rows: DataFrame, model: BoostedTrees, trees: list[Tree]) -> DataFrame:
    """The rows with their margins after ``trees`` as well."""
    width = len(model.features)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column(4).to_numpy(zero_copy_only=False) + model.margins(_unpacked(batch, width), trees)
            yield pa.record_batch([*batch.columns[:4], pa.array(margin)], schema=batch.schema)

    return stored(rows.mapInArrow(move, _ROWS), "boosting")


_SUMS = pa.schema([("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])


def _histograms(rows: DataFrame, model: BoostedTrees, since: list[Tree], tree: Tree, level: int, number: int, settings: Settings) -> tuple[np.ndarray, tuple[float, float]]:
    """(gradient and hessian sums by node of the level, feature and bin; squared error and count of the validation rows)."""
    width, first, nodes = len(model.features), (1 << level) - 1, 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, nodes, width, 256))
        error = np.zeros(2)
        for batch in batches:
            bins = _unpacked(batch, width)
            label, draw = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            validates = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            off = batch.column(4).to_numpy(zero_copy_only=False) + model.margins(bins, since) - label
            error += ((off[validates] ** 2).sum(), validates.sum())
            # a row's draw turns from tree to tree
            used = ~validates & (np.mod(draw + number * 0.6180339887498949, 1.0) < settings.subsample)
            node = tree.leaves(bins) - first
            used &= (node >= 0) & (node < nodes)
            first_cell, own_off = node[used] * 256, off[used]
            for f, own in enumerate(np.ascontiguousarray(bins[used].T)):
                index = first_cell + own
                sums[0, :, f] += np.bincount(index, own_off, nodes * 256).reshape(nodes, 256)
                sums[1, :, f] += np.bincount(index, minlength=nodes * 256).reshape(nodes, 256)
        at = np.nonzero(sums[1])
        columns = [*at, sums[0][at], sums[1][at]]
        last = [(-1,), (-1,), (-1,), error[:1], error[1:]]
        yield pa.record_batch([pa.array(np.concatenate(pair), t) for pair, t in zip(zip(columns, last), _SUMS.types)], schema=_SUMS)

    partial = rows.mapInArrow(add, "node long, feature int, bin int, g double, h double")
    table = partial.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    node, feature, where, g, h = (table.column(i).to_numpy() for i in range(5))
    out = np.zeros((2, nodes, width, 256))
    real = node >= 0
    out[:, node[real], feature[real], where[real]] = np.stack([g[real], h[real]])
    return out, (float(g[~real].sum()), float(h[~real].sum()))


def _grow(tree: Tree, level: int, sums: np.ndarray, settings: Settings) -> bool:
    """Split the level's nodes by the most gain; whether any was."""
    grown, first = False, (1 << level) - 1
    shrink = settings.learning_rate
    for n in range(1 << level):
        g, h = sums[:, n]
        total_g, total_h = g[0].sum(), h[0].sum()
        if total_h <= 0:
            continue
        at = first + n
        if level == 0:
            tree.value[at] = -shrink * total_g / (total_h + settings.reg_lambda)
        whole = total_g**2 / (total_h + settings.reg_lambda)
        present_g, present_h = np.cumsum(g[:, :_MISSING], 1), np.cumsum(h[:, :_MISSING], 1)
        best = (settings.gamma + 1e-9 * max(1.0, whole), None)
        for missing_left in (True, False):
            left_g = present_g + (g[:, _MISSING :] if missing_left else 0)
            left_h = present_h + (h[:, _MISSING :] if missing_left else 0)
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + settings.reg_lambda + 1e-12) + right_g**2 / (right_h + settings.reg_lambda + 1e-12) - whole
            gain[(left_h < settings.min_child_weight) | (right_h < settings.min_child_weight)] = -np.inf
            f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[f, b] > best[0]:
                best = (gain[f, b], (int(f), int(b), missing_left, left_g[f, b], left_h[f, b]))
        if best[1] is None:
            continue
        f, b, missing_left, left_g, left_h = best[1]
        tree.feature[at], tree.threshold[at], tree.missing_left[at] = f, b, missing_left
        tree.value[2 * at + 1] = float(-shrink * left_g / (left_h + settings.reg_lambda))
        tree.value[2 * at + 2] = float(-shrink * (total_g - left_g) / (total_h - left_h + settings.reg_lambda))
        grown = True
    return grown


def fit_boosted(df: DataFrame, features: list[str], label: str, settings: Settings = Settings(), validates: Column | None = None) -> BoostedTrees:
    """Fit ``settings.n_estimators`` trees, or fewer where the rows that ``validates`` marks tell so, see the module."""
    ship_package(df.sparkSession)
    scan = first_scan(df, features)
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in sketched_quantiles(scan, [k / settings.bins for k in range(1, settings.bins)]).collect():  # bins - 1 a feature
        found[r["column"]].append(r["value"])
    cuts = [sorted(set(found[f])) for f in features]
    marked = F.lit(False) if validates is None else validates
    y = F.col(f"`{label}`").cast("double")
    base = df.filter(~F.coalesce(marked, F.lit(False)) & ~F.isnan(y)).agg(F.avg(y)).first()[0]
    model = BoostedTrees(list(features), cuts, base or 0.0)
    rows, since, errors = _prepared(df, model, y, marked, settings), [], []
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for number in range(settings.n_estimators):
            tree = Tree.root(settings.max_depth)
            for level in range(settings.max_depth):
                sums, (error, n) = _histograms(held, model, since, tree, level, number, settings)
                if level == 0:
                    errors.append(error / n if n else 0.0)
                    best = int(np.argmin(errors))
                    if n and settings.patience and number - best >= settings.patience:
                        model.trees = model.trees[:best]
                        return model
                if not _grow(tree, level, sums, settings):
                    break
            model.trees.append(tree)
            since.append(tree)
            if len(since) == _STORED_EVERY:
                moved = _moved(held, model, since)
                held.unpersist()
                held, since = moved.persist(StorageLevel.MEMORY_AND_DISK), []
        return model
    finally:
        held.unpersist()


def score_boosted(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """All rows and columns of ``df`` plus the prediction."""
    width = len(model.features)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(_columns(batch, width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[width:], pa.array(model.base + model.margins(bins))], names=[*batch.schema.names[width:], PREDICTION]
            )

    ship_package(df.sparkSession)
    values = df.select(*_numbers(model.features), *[F.col(f"`{c}`") for c in df.columns])
    return values.mapInArrow(predict, T.StructType([*df.schema, T.StructField(PREDICTION, T.DoubleType())]))


def save_boosted(model: BoostedTrees, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_boosted(spark: SparkSession, path: str) -> BoostedTrees:
    return BoostedTrees.from_json(spark.read.text(path, wholetext=True).first()[0])
