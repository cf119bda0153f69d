"""Boosting over binned records against Spark's own, which it stands for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.plans import binned
from wayfare.plans.models import MODELS, Trained, fit, load_model, save_model, score
from wayfare.sources.sinks import shared_folder

NAMES = ["a", "b", "c", "one"]


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randrange(25), rng.randrange(-3, 4)
        rows.append((i, a, b, float(c), 7, 3 * a + (b % 5) * c + rng.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "i long, a double, b int, c double, one int, y double").repartition(3).cache()


@pytest.fixture(scope="module")
def few(spark):
    return table(spark, 2000)


def predicted(model, df):
    return {r["i"]: r["prediction"] for r in score(model, df).collect()}


def by_spark(monkeypatch, *args, **params):
    with monkeypatch.context() as patch:
        patch.setitem(MODELS, "boosted", MODELS["boosted"]._replace(binned=False))
        return fit(*args, **params)


@pytest.mark.parametrize(("rows", "params"), [(13_000, {"n_estimators": 12, "max_depth": 3}), (700, {"n_estimators": 10, "max_depth": 8})])
def test_the_model_is_that_of_spark(spark, monkeypatch, rows, params):
    """With more rows than splits are sampled from, a table made anew from the first, and levels whose nodes tasks combine."""
    df = table(spark, rows)
    own, other = fit(df, "boosted", "y", NAMES, partition_rows=3000, **params), by_spark(monkeypatch, df, "boosted", "y", NAMES, partition_rows=3000, **params)
    ours, theirs = own.stages[-1], other.stages[-1]
    assert type(ours) is type(theirs) and ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures
    assert ours.getMaxDepth() == params["max_depth"] and ours.getLabelCol() == "y"
    want, got = predicted(other, df), predicted(own, df)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    if rows > 10_000:  # many rows a node, so no two splits are equally good
        assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
        assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())


def test_passes_have_few_tasks_however_many_partitions(spark, few):
    """Before, every level of every tree ran a task for each partition of the rows."""
    context = spark.sparkContext
    context.setJobGroup("binned-tasks", "a boosted fit")
    try:
        fit(few, "boosted", "y", NAMES, partition_rows=50, n_estimators=10, max_depth=2)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("binned-tasks")]
    last = [tracker.getStageInfo(max(j.stageIds)).numTasks for j in jobs if j and j.stageIds]
    assert len(last) >= 21 and sorted(last)[len(last) // 2] <= binned._LANES
    assert [binned._lanes(*x) for x in ((100, 1), (10**6, 40), (57 * 10**6, 57), (10**9, 1000))] == [1, 8, 15, 250]


@pytest.mark.parametrize("subsample", [1.0, 0.6])
def test_it_does_not_depend_on_the_layout(spark, few, monkeypatch, subsample):
    monkeypatch.setattr(binned, "_CHUNK", 100)  # several records a partition
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        one, nine = (fit(few.repartition(n, "a"), "boosted", "y", NAMES, partition_rows=500, n_estimators=10, max_depth=3, subsample=subsample) for n in (1, 9))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert one.stages[-1].toDebugString.split("\n", 1)[1] == nine.stages[-1].toDebugString.split("\n", 1)[1]
    error = score(one, few).agg(F.avg((F.col("prediction") - F.col("y")) ** 2) / F.var_pop("y")).first()[0]
    assert error < 0.4


def test_it_is_saved_and_loaded(spark, few):
    params = {"n_estimators": 10, "max_depth": 2}
    model = fit(few, "boosted", "y", NAMES, **params)
    folder = shared_folder(spark, "models")
    save_model(Trained(model, few, few, score(model, few)), folder, "trees", "boosted", "y", NAMES, "2024-01-01", **params)
    assert predicted(load_model(folder, "trees"), few) == predicted(model, few)


@pytest.mark.parametrize("column", ["a", "y"])
def test_missing_values_fail_the_fit(few, column):
    for value in (F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))):
        broken = few.withColumn(column, F.when(F.col("i") != 5, F.col(column)).otherwise(value))
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps the worker's error
            fit(broken, "boosted", "y", NAMES, n_estimators=10)


def test_odd_tables(few, monkeypatch):
    with pytest.raises(ValueError, match="no rows"):
        fit(few.limit(0), "boosted", "y", NAMES, n_estimators=10)
    same = few.withColumn("y", F.lit(3.0))
    for df in (same, few.filter("i = 1"), few.select("i", "y", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("c"), F.lit(2).alias("one"))):
        own, other = fit(df, "boosted", "y", NAMES, n_estimators=10), by_spark(monkeypatch, df, "boosted", "y", NAMES, n_estimators=10)
        got, want = predicted(own, df), predicted(other, df)
        assert all(got[i] == pytest.approx(want[i]) for i in want)
        assert [t.numNodes for t in own.stages[-1].trees] == [t.numNodes for t in other.stages[-1].trees]
