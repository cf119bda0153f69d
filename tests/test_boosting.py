"""Second-order boosting against plain Python and on data with a known answer."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.plans.boosting import BoostedTrees, Settings, _unpacked, fit_boosted, load_boosted, save_boosted, score_boosted
from wayfare.sources.sinks import shared_folder


def predicted(model, df, key="i"):
    return {r[key]: r["prediction"] for r in score_boosted(model, df).collect()}


@pytest.fixture(scope="module")
def curved(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        a, b = rng.randrange(30), rng.randrange(12)
        rows.append((i, float(a), None if i % 10 == 3 else float(b), math.sin(a / 4) * 5 + (b if i % 10 != 3 else 20) + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "i long, a double, b double, y double").repartition(3).cache()


def test_it_fits_a_curve_with_missing_values(curved):
    model = fit_boosted(curved, ["a", "b"], "y", Settings(n_estimators=12, max_depth=4, reg_lambda=0.1))
    scored = score_boosted(model, curved)
    assert scored.columns == ["i", "a", "b", "y", "prediction"] and len(model.trees) == 12
    assert scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0] < 0.6


def test_bins_are_read_from_the_buffer_of_a_sliced_batch():
    rows = np.arange(24, dtype=np.uint8).reshape(8, 3)
    batch = pa.record_batch([pa.array([r.tobytes() for r in rows], pa.binary())], names=["bins"])
    assert (_unpacked(batch, 3) == rows).all() and (_unpacked(batch.slice(2, 4), 3) == rows[2:6]).all()
    assert _unpacked(batch.slice(0, 0), 3).shape == (0, 3)
    assert np.shares_memory(_unpacked(batch, 3), np.frombuffer(batch.column(0).buffers()[2], np.uint8))


def test_one_round_matches_the_best_split_of_plain_python(spark, curved):
    settings = Settings(n_estimators=1, max_depth=1, learning_rate=0.5, reg_lambda=2.0)
    model = fit_boosted(curved, ["a", "b"], "y", settings)
    rows = curved.collect()
    base = np.mean([r["y"] for r in rows])
    grads = [(r["a"], r["b"], base - r["y"]) for r in rows]
    total = sum(g for *_, g in grads)
    best = None
    for f in (0, 1):
        for cut in sorted({r[f] for r in grads if r[f] is not None}):
            for missing_left in (True, False):
                left = [g for *x, g in grads if (missing_left if x[f] is None else x[f] <= cut)]
                right = len(grads) - len(left)
                gain = sum(left) ** 2 / (len(left) + 2) + (total - sum(left)) ** 2 / (right + 2)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, cut, missing_left, -0.5 * sum(left) / (len(left) + 2), -0.5 * (total - sum(left)) / (right + 2))
    _, f, cut, missing_left, low, high = best
    want = {r["i"]: base + (low if (missing_left if r[f + 1] is None else r[f + 1] <= cut) else high) for r in rows}
    got = predicted(model, curved)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_margins_stay_right_over_stored_tables_and_layouts(spark, curved):
    settings = Settings(n_estimators=7, max_depth=2, subsample=0.7)
    one, other = (predicted(fit_boosted(curved.repartition(n), ["a", "b"], "y", settings), curved) for n in (1, 6))
    assert all(one[i] == pytest.approx(other[i]) for i in one)


def test_rounds_end_when_validation_gets_worse(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randrange(50)), rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    model = fit_boosted(df, ["x"], "y", Settings(n_estimators=30, max_depth=4, patience=2), F.col("i") % 3 == 0)
    assert len(model.trees) < 10  # noise: more trees only fit the training rows


def test_saved_and_odd_tables(spark, curved):
    model = fit_boosted(curved, ["a", "b"], "y", Settings(n_estimators=2, max_depth=2))
    path = shared_folder(spark, "boosted")
    save_boosted(model, spark, path)
    assert load_boosted(spark, path) == model == BoostedTrees.from_json(model.to_json())
    odd = spark.createDataFrame([(1, None, None, "x")], "i long, a double, b double, name string")
    (row,) = score_boosted(model, odd).collect()
    assert row["name"] == "x" and math.isfinite(row["prediction"])
    empty = fit_boosted(curved.limit(0), ["a"], "y", Settings(n_estimators=2))
    assert predicted(empty, curved.limit(1)) == {k: 0.0 for k in predicted(empty, curved.limit(1))}
    constant = fit_boosted(curved.withColumn("y", F.lit(3.0)), ["a"], "y", Settings(n_estimators=2))
    assert set(predicted(constant, curved).values()) == {3.0}
