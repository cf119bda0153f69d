import math
import random

import numpy as np
import pytest

from wayfare.operators import quantiles
from wayfare.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, columns, probs=PROBS, **options):
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, names, probs, **options).collect()}
    for name, values in columns.items():
        present = [v for v in values if v is not None and not math.isnan(v)]
        for p in probs:
            if not present:
                assert (name, p) not in got
            else:
                at = p * (len(present) - 1)
                low, high = (sorted(present)[edge(at)] for edge in (math.floor, math.ceil))
                assert got[name, p] == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12, abs=1e-12))


def test_matches_numpy_on_skewed_columns(spark):
    rng = random.Random(7)
    n = 2000
    check(
        spark,
        {
            "uniform": [rng.random() for _ in range(n)],
            "hot": [3.0 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)],
            "outliers": [rng.random() if i else 1e12 for i in range(n)],
            "nulls": [None if rng.random() < 0.5 else rng.expovariate(1) for _ in range(n)],
            "nans": [math.nan if rng.random() < 0.3 else rng.gauss(0, 1e6) for _ in range(n)],
            "constant": [5.0] * n,
            "empty": [None] * n,
        },
    )


def test_narrow_brackets_stay_exact(spark, monkeypatch):
    """Sketches far smaller than the table, so that most values lie outside the brackets."""
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 256)
    monkeypatch.setattr(quantiles, "BINS", 7)
    rng = random.Random(8)
    columns = {"x": [rng.lognormvariate(0, 4) for _ in range(20_000)], "hot": [float(rng.randrange(3)) for _ in range(20_000)]}
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values())), "x double, hot double").repartition(5)
    scan = quantiles.first_scan(df, names, size=256)
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles.quantiles_of(df, scan, PROBS).collect()}
    for name, values in columns.items():
        for p in PROBS:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    for r in quantiles.sketched_quantiles(scan, PROBS).collect():
        values = np.sort(columns[r["column"]])
        low, high = (np.searchsorted(values, r["value"], side) / len(values) for side in ("left", "right"))
        assert low - 3 * quantiles.rank_error(256) <= r["prob"] <= high + 3 * quantiles.rank_error(256)


def test_two_scans(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(3000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y").mapInArrow(count, "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5, 0.9]).count() == 4
    assert read.value == 2 * 3000


def test_infinities_rank_as_values(spark):
    inf = math.inf
    check(spark, {"both": [-inf, -inf, 1.0, 2.0, inf, inf, inf]}, [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0])
    check(spark, {"ends": [-1.7e308, 1.7e308, 0.0, 5.0, None]}, [0.0, 1 / 3, 1.0])
    check(spark, {"all": [inf, inf]}, [0.0, 0.5, 1.0])


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [-1.0, -1.0, 4.0]])
def test_few_rows(spark, values):
    check(spark, {"x": values})
