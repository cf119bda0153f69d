"""Spark's gradient-boosted regression trees, fitted over stored bins instead of row objects.

Same learner as ``GBTRegressor`` with squared error, and the same model class: candidate splits from the sample and by the rule of Spark, trees grown level by level
by variance, residuals of the trees so far as the next label. Only the passes over the rows differ:

1. Rows become a byte a feature and their label, ``_CHUNK`` rows to one record; the records are cached, spilling to disk.
2. A level of a tree is one pass: tasks add up counts and labels by (node, feature, bin), features that together have few cells in one go. The sums of the
   partitions are added in their order, by the driver, or by tasks for each ``_BLOCK`` nodes of a level that has more. As every pass pays for its tasks, there
   are ``_LANES`` partitions until one would hold more than ``_LANE_ROWS`` rows; and records are an RDD, whose passes start in half the time of a DataFrame's.
3. After a tree each record's labels become the residuals in a new cached table; every ``_RENEWED`` trees it is made from the first one again, which bounds
   the steps that a lost block is recomputed by.

Splits whose gains are equal but for rounding are resolved to the first feature and threshold. Neither the cluster nor the input's layout changes the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wayfare.shipping import ship_package

_CHUNK = 65_536
_RENEWED = 10
_SAMPLED = 10_000  # rows that Spark takes its candidate splits from
_CELLS = 8_192  # of nodes and joint bins that are added up in one go
_BLOCK = 64  # nodes whose sums travel together
_LANES = 8
_LANE_ROWS = 4_000_000
_BY_NODE = 6  # levels whose nodes are compared one by one, each with all rows
_EPSILON = float(np.finfo(float).eps)
_NEAR = 1e-9


@dataclass
class _Tree:
    """Nodes in heap order: the children of node i are 2i + 1 and 2i + 2. A node without a feature is a leaf, or not there."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray  # bins up to it go left
    count: np.ndarray
    total: np.ndarray
    square: np.ndarray
    gain: np.ndarray
    valid: np.ndarray

    @staticmethod
    def root(depth: int) -> _Tree:
        size = (1 << depth + 1) - 1
        return _Tree(depth, np.full(size, -1), np.zeros(size, int), *(np.zeros(size) for _ in range(4)), np.ones(size, bool))

    def positions(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Each row's node among those of the level; a row of a leaf above it goes to the leftmost under the leaf."""
        at = np.zeros(bins.shape[1], np.uint16)
        for depth in range(level):
            first = (1 << depth) - 1
            feature, cut = self.feature[first : 2 * first + 1], self.cut[first : 2 * first + 1]
            if depth < _BY_NODE:
                right = np.zeros(len(at), bool)
                for node in np.flatnonzero(feature >= 0).tolist():  # plain integers, which leave the arrays' types as they are
                    right |= (at == node) & (bins[feature[node]] > int(cut[node]))
            else:
                right = (feature[at] >= 0) & (bins[feature[at], np.arange(len(at))] > cut[at])
            at = (at << 1) | right
        return at

    def values(self) -> np.ndarray:
        """The prediction at each position of the last level."""
        out = self.total / np.maximum(self.count, 1)
        for i in range((1 << self.depth) - 1):
            if self.feature[i] < 0:
                out[2 * i + 1] = out[2 * i + 2] = out[i]
        return out[(1 << self.depth) - 1 :]

    def impurity(self, i: int) -> float:
        return (self.square[i] - self.total[i] ** 2 / self.count[i]) / self.count[i] if self.count[i] else 0.0


def _thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Spark's candidate splits of a feature from a sample that is expected to have so many rows."""
    found, times = np.unique(values[values != 0], return_counts=True)
    times = times.astype(float)
    zeros = expected - times.sum()
    if zeros > _EPSILON * times.sum() * 100:
        at = int(np.searchsorted(found, 0.0))
        found, times = np.insert(found, at, 0.0), np.insert(times, at, zeros)
    between = (found[:-1] + found[1:]) / 2
    if len(between) <= most:
        return between
    stride = target = expected / (most + 1)
    seen, cuts = 0.0, []
    for i in range(len(between)):
        seen += times[i]
        if abs(seen - target) < abs(seen + times[i + 1] - target):
            cuts.append(between[i])
            target += stride
    return np.array(cuts)


def _sample(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that Spark's tree learners draw to find splits."""
    if fraction >= 1:
        return rows
    spark = rows.sparkSession
    drawn = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.javaRDD().sample(False, fraction, drawn), rows._jdf.schema()), spark)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """(column, row) values; the last column is the label."""
    out = np.stack([column.to_numpy(zero_copy_only=False).astype(float) for column in batch.columns])
    if not np.isfinite(out[:-1]).all():
        raise ValueError("features must not be NULL, NaN or infinite")
    if not np.isfinite(out[-1]).all():
        raise ValueError("labels must not be NULL, NaN or infinite")
    return out


Record = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # place, (feature, row) bins, labels, squares by position


def _lanes(rows: int, partitions: int) -> int:
    return max(min(partitions, _LANES), -(-rows // _LANE_ROWS))


def _packed(rows: DataFrame, cuts: list[np.ndarray], lanes: int) -> RDD[Record]:
    """The records, dealt to so many partitions in a fixed order."""
    chunk = _CHUNK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, n = TaskContext.get().partitionId() << 32, [], 0

        def record() -> pa.RecordBatch:
            bins, label = (np.concatenate(x, -1).tobytes() for x in zip(*waiting))
            return pa.record_batch([pa.array([place]), pa.array([bins]), pa.array([label])], names=["place", "bins", "label"])

        for batch in batches:
            values = _numbers(batch)
            bins = np.empty((len(cuts), batch.num_rows), np.uint8)
            for f, own in enumerate(cuts):
                bins[f] = np.searchsorted(own, values[f], side="left")
            waiting.append((bins, values[-1]))
            n += batch.num_rows
            if n >= chunk:
                yield record()
                place, waiting, n = place + 1, [], 0
        if n:
            yield record()

    def unpacked(row: Row) -> Record:
        return row.place, np.frombuffer(row.bins, np.uint8).reshape(len(cuts), -1), np.frombuffer(row.label), np.zeros(0)

    lane = F.expr(f"cast(pmod(shiftright(place, 32) + (place & {(1 << 32) - 1}), {lanes}) AS int)")
    packed = rows.mapInArrow(pack, "place long, bins binary, label binary")
    return packed.repartitionById(lanes, lane).sortWithinPartitions("place").rdd.map(unpacked)


def _moved(table: RDD[Record], trees: list[_Tree], rate: float, first: bool) -> RDD[Record]:
    """The records with the residuals after ``trees`` as labels, and by position the sum of squares of the labels that the last of them was fitted to.

    A residual is twice what is missing, the negative gradient of the squared error; the first tree of a fit counts whole, the others at ``rate``.
    """
    steps = [(t, 2.0, 2 * t.values()) if first and not i else (t, 1.0, 2 * rate * t.values()) for i, t in enumerate(trees)]

    def move(record: Record) -> Record:
        place, bins, label, squares = record
        for tree, scale, change in steps:
            at = tree.positions(bins, tree.depth)
            squares = np.bincount(at, label * label, 1 << tree.depth)
            label = scale * label - change[at]
        return place, bins, label, squares

    return table.map(move)


def _groups(sizes: list[int], most: int) -> list[list[int]]:
    """Features of more than one bin, put together while their joint bins are no more than ``most``."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted((f for f, n in enumerate(sizes) if n > 1), key=lambda f: -sizes[f]):
        fits = next((i for i, (cells, _) in enumerate(groups) if cells * sizes[f] <= most), None)
        if fits is None:
            groups.append((sizes[f], [f]))
        else:
            groups[fits] = (groups[fits][0] * sizes[f], [*groups[fits][1], f])
    return [g for _, g in groups]


def _added(table: RDD[Record], tree: _Tree, level: int, sizes: list[int], number: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts and sums of labels by node, feature and bin; squares of labels by node; the records' own ``squares`` by position)."""
    nodes = 1 << level
    groups = _groups(sizes, max(1, _CELLS // nodes))
    block = min(nodes, _BLOCK)
    ends = 1 << tree.depth if number else 0

    def add(part: int, records: Iterator[Record]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        joint = [np.zeros((2, nodes * int(np.prod([sizes[f] for f in g])))) for g in groups]
        plain, square, before = np.zeros((2, nodes)), np.zeros(nodes), np.zeros(ends)
        for place, bins, label, squares in records:
            before[: len(squares)] += squares
            if rate < 1:
                drawn = np.flatnonzero(np.random.default_rng([seed, number, place]).random(len(label)) < rate)
                bins, label = np.ascontiguousarray(bins[:, drawn]), label[drawn]
            at = tree.positions(bins, level).astype(np.int64)
            square += np.bincount(at, label * label, nodes)
            if not groups:
                plain += np.bincount(at, minlength=nodes), np.bincount(at, label, nodes)
            for g, sums in zip(groups, joint):
                cells = sums.shape[1] // nodes
                code = bins[g[0]].astype(np.uint16)
                for f in g[1:]:
                    code *= sizes[f]
                    code += bins[f]
                where = at * cells
                where += code
                sums[0] += np.bincount(where, minlength=nodes * cells)
                sums[1] += np.bincount(where, label, nodes * cells)
        single = {}
        for g, sums in zip(groups, joint):
            shaped = sums.reshape(2, nodes, *[sizes[f] for f in g])
            for i, f in enumerate(g):
                single[f] = shaped.sum(tuple(2 + j for j in range(len(g)) if j != i))
        if groups:
            plain = single[groups[0][0]].sum(2)
        for b in range(0, nodes, block):
            held = [plain[:, b : b + block], square[b : b + block], *(single[f][:, b : b + block] for f in sorted(single)), before if b == 0 else before[:0]]
            yield b // block, (part, np.concatenate([x.ravel() for x in held]))

    partial = table.mapPartitionsWithIndex(add)
    if nodes > block:  # else few enough for the driver to add up, without a shuffle
        partial = partial.groupByKey(nodes // block).mapValues(lambda own: (0, sum(x for _, x in sorted(own, key=lambda o: o[0]))))
    sums, square, before = np.zeros((2, nodes, len(sizes), max(sizes))), np.zeros(nodes), np.zeros(ends)
    for b, (_, cells) in sorted(partial.collect(), key=lambda o: (o[0], o[1][0])):
        at = slice(b * block, (b + 1) * block)
        split = np.cumsum([2 * block, block, *(2 * block * n for n in sizes if n > 1)])
        plain, squares, *single, last = np.split(cells, split)
        own = iter(single)
        for f, n in enumerate(sizes):
            sums[:, at, f, :n] += (next(own) if n > 1 else plain).reshape(2, block, n)
        square[at] += squares
        if not b:
            before += last
    return sums, square, before


def _grow(tree: _Tree, level: int, sums: np.ndarray, square: np.ndarray, alive: set[int]) -> set[int]:
    """Split the nodes ``alive`` of the level by the most gain; their children."""
    first, children = (1 << level) - 1, set()
    for i in sorted(alive):
        count, total = sums[:, i - first]
        if not level:
            tree.count[0], tree.total[0] = count[0].sum(), total[0].sum()
        tree.square[i] = square[i - first]
        if not tree.count[i] or level and abs(tree.impurity(i)) < _EPSILON:
            continue
        left_n, left_y = np.cumsum(count, 1), np.cumsum(total, 1)
        right_n, right_y = left_n[:, -1:] - left_n, left_y[:, -1:] - left_y
        gain = left_y**2 / np.maximum(left_n, 1) + right_y**2 / np.maximum(right_n, 1) - tree.total[i] ** 2 / tree.count[i]
        gain = np.where((left_n >= 1) & (right_n >= 1), gain / tree.count[i], -np.inf)
        best = gain.max()
        tree.valid[i] = best >= 0
        if not 0 < best < np.inf:
            continue
        f, b = np.unravel_index(int(np.argmax(gain >= best * (1 - _NEAR))), gain.shape)
        tree.feature[i], tree.cut[i], tree.gain[i] = f, b, gain[f, b]
        for child, n, y in ((2 * i + 1, left_n, left_y), (2 * i + 2, right_n, right_y)):
            tree.count[child], tree.total[child] = n[f, b], y[f, b]
            children.add(child)
    return children


def _java_model(trees: list[_Tree], cuts: list[np.ndarray], estimator: GBTRegressor, rows: DataFrame):
    context = rows.sparkSession.sparkContext
    jvm, new_array = context._jvm, context._gateway.new_array
    # looked up once: every step of such a path asks the JVM
    ml = jvm.org.apache.spark.ml
    inner, leaf, split, regressor = ml.tree.InternalNode, ml.tree.LeafNode, ml.tree.ContinuousSplit, ml.regression.DecisionTreeRegressionModel
    calculator, double, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.double, jvm.java.util.Arrays.copyOfRange
    wrap = jvm.java.nio.ByteBuffer.wrap

    def java_tree(tree: _Tree):
        held = np.stack([tree.count, tree.total, tree.square], 1)
        every = new_array(double, held.size)
        wrap(bytearray(held.astype(">f8").tobytes())).asDoubleBuffer().get(every)

        def node(i: int):
            """(node, prediction of a leaf); leaves that predict the same are one, as Spark has it."""
            mean, impurity = (float(tree.total[i] / tree.count[i]), float(tree.impurity(i))) if tree.count[i] else (0.0, 0.0)
            if tree.feature[i] >= 0:
                (left, low), (right, high) = node(2 * i + 1), node(2 * i + 2)
                if low is None or low != high:
                    by = split(int(tree.feature[i]), float(cuts[tree.feature[i]][tree.cut[i]]))
                    return inner(mean, impurity, float(tree.gain[i]), left, right, by, calculator(part(every, 3 * i, 3 * i + 3), int(tree.count[i]))), None
            return leaf(mean, impurity if tree.valid[i] else -1.0, calculator(part(every, 3 * i, 3 * i + 3), int(tree.count[i]))), mean

        return node(0)[0]

    models, weights = new_array(regressor, len(trees)), new_array(double, len(trees))
    for i, tree in enumerate(trees):
        models[i] = regressor(f"{estimator.uid}_{i}", java_tree(tree), len(cuts))
        weights[i] = estimator.getStepSize() if i else 1.0
    return ml.regression.GBTRegressionModel(estimator.uid, models, weights, len(cuts))


def fit_binned(rows: DataFrame, n: int, partitions: int, features: list[str], estimator: GBTRegressor) -> GBTRegressionModel:
    """Fit ``estimator`` to the ``n`` cached rows, arranged in ``partitions``, on numeric ``features``. ``rows`` are released once they are binned."""
    if not n:
        raise ValueError("there are no rows to fit")
    ship_package(rows.sparkSession)
    seed, rate, depth = estimator.getSeed(), estimator.getStepSize(), estimator.getMaxDepth()
    numbers = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*features, estimator.getLabelCol()])])
    bins = min(estimator.getMaxBins(), n)
    fraction = min(1.0, max(bins * bins, _SAMPLED) / n)
    drawn = _sample(numbers, fraction, seed).toArrow()
    cuts = [_thresholds(drawn.column(i).to_numpy(), fraction * n, bins - 1) for i in range(len(features))]
    sizes = [len(x) + 1 for x in cuts]

    base = table = _packed(numbers, cuts, _lanes(n, partitions)).persist(StorageLevel.MEMORY_AND_DISK)
    trees, outdated = [], rows

    def added(tree: _Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums of a pass; a tree's first one also tells the squares of the leaves that end the tree before."""
        sums, square, squares = _added(table, tree, level, sizes, len(trees), estimator.getSubsamplingRate(), seed)
        if not level and trees:
            ends = slice((1 << depth) - 1, None)
            trees[-1].square[ends] = np.where(trees[-1].count[ends] > 0, squares, 0.0)
        return sums, square

    try:
        while len(trees) < estimator.getMaxIter():
            tree, alive = _Tree.root(depth), {0}
            for level in range(depth):
                if not alive:
                    break
                sums, square = added(tree, level)
                if outdated is not None and not level:  # the table made from it is cached now
                    outdated.unpersist()
                    outdated = None
                alive = _grow(tree, level, sums, square, alive)
            trees.append(tree)
            outdated, renewed = None if table is base else table, len(trees) % _RENEWED == 0
            table = _moved(base if renewed else table, trees if renewed else trees[-1:], rate, renewed or len(trees) == 1)
            table.persist(StorageLevel.MEMORY_AND_DISK)
        added(_Tree.root(depth), 0)
    finally:
        for held in (base, table, outdated):
            if held is not None:
                held.unpersist()
    return estimator._copyValues(GBTRegressionModel(_java_model(trees, cuts, estimator, rows)))
