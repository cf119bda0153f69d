import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from wayfare.catalog import modelling
from wayfare.operators.evaluation import prediction_sample, regression_metrics, residual_histogram
from wayfare.operators.features import model_features, raw_features
from wayfare.operators.importance import permutation_importance, with_partners
from wayfare.operators.splits import best_splits, split_gains
from wayfare.plans.models import (
    FIT_ROWS,
    MODELS,
    _arranged,
    ablation,
    coefficients,
    compare_models,
    evaluate_saved,
    evaluation_report,
    feature_importance,
    fit,
    fit_partitions,
    index_strings,
    load_model,
    save_model,
    saved_models,
    score,
    score_trips,
    train_and_score,
)
from wayfare.roles import TLC
from wayfare.sources.sinks import shared_folder


@pytest.fixture(scope="module")
def priced(trips):
    """Forty days of trips whose fare is 3 + 2.5 per mile, half a mile of noise in tips."""
    rng = random.Random(5)
    changes = []
    for n in range(400):
        miles = rng.uniform(0.5, 20)
        changes.append(
            {
                "tpep_pickup_datetime": dt.datetime(2024, 1, 1, n % 24) + dt.timedelta(days=n % 40),
                "trip_distance": miles,
                "fare_amount": 3 + 2.5 * miles,
                "tip_amount": 0.2 * miles + rng.random(),
                "PULocationID": rng.choice([1, 50, 60, 132]),
                "RatecodeID": rng.choice([1.0, 2.0, None]),
                "minutes": 5 + miles,
            }
        )
    return trips(*changes).cache()


def test_registry_checks_parameters(spark):
    assert set(MODELS) == {"linear", "dtree", "rforest", "gbt", "boosted"}
    built = MODELS["boosted"].build("fare", n_estimators=30, learning_rate=0.1)
    assert (built.getMaxIter(), built.getMaxDepth(), built.getStepSize()) == (30, 6, 0.1)
    with pytest.raises(ValueError, match="outside"):
        MODELS["dtree"].build("fare", maxDepth=99)
    with pytest.raises(ValueError, match="no parameter"):
        MODELS["linear"].build("fare", depth=3)


def test_linear_finds_the_line(spark, priced):
    trained = train_and_score(priced, TLC, "linear", "fare_amount", ["trip_distance"])
    terms = {r["term"]: r["coefficient"] for r in coefficients(trained.model, spark, ["trip_distance"]).collect()}
    assert terms == {"trip_distance": pytest.approx(2.5), "intercept": pytest.approx(3.0)}
    assert regression_metrics(trained.scored, "fare_amount").first()["r2"] == pytest.approx(1.0)
    assert feature_importance(trained.model, spark, ["trip_distance"]) is None


@pytest.mark.parametrize(
    ("key", "params"),
    [
        ("dtree", {}),
        ("rforest", {"numTrees": 5}),
        ("gbt", {"maxIter": 3}),
        ("boosted", {"n_estimators": 10, "max_depth": 3}),
    ],
)
def test_trees_learn_distance(spark, priced, key, params):
    features = model_features(TLC)
    trained = train_and_score(priced, TLC, key, "fare_amount", features, **params)
    metrics = regression_metrics(trained.scored, "fare_amount").first()
    assert metrics["n"] == trained.test.count() > 0
    assert metrics["r2"] > 0.8
    ranked = feature_importance(trained.model, spark, features, top=12).collect()
    assert len(ranked) == 12
    # the two carry the same information, so a single tree may use only one of them
    assert ranked[0]["feature"] in {"trip_distance", "log_distance"}
    assert set(priced.columns) <= set(trained.scored.columns)


def test_metrics_agree_with_spark_ml(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y double, prediction double")
    row = regression_metrics(df, "y").first()
    for name in ("rmse", "mae", "r2"):
        assert row[name] == pytest.approx(RegressionEvaluator(labelCol="y", metricName=name).evaluate(df))
    sample = prediction_sample(df, "y", "id", rows=20).collect()
    assert len(sample) == 20
    assert all(r["error"] == r["predicted"] - r["actual"] for r in sample)
    bins = residual_histogram(df, "y", -5.0, 5.0).collect()
    assert sum(r["rows"] for r in bins) == 200
    assert max(r["bin"] for r in bins) <= 40


def test_training_cap_leaves_the_holdout_whole(priced):
    full = train_and_score(priced, TLC, "linear", "fare_amount", ["trip_distance"])
    capped = train_and_score(priced, TLC, "linear", "fare_amount", ["trip_distance"], max_rows=100, keys=["VendorID"])
    assert capped.train.count() < full.train.count()
    assert capped.scored.count() == full.scored.count()


def test_missing_feature_fails_the_fit(priced):
    broken = priced.withColumn("trip_distance", F.when(F.col("VendorID") > 0, F.col("trip_distance")))
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps the assembler's error
        fit(broken, "linear", "fare_amount", ["trip_distance"])


def test_save_load_evaluate_compare(spark, priced):
    folder = shared_folder(spark, "models")
    assert saved_models(spark, folder).count() == 0
    kept = {}
    for model_id, target, at in (("old", "fare_amount", "2024-01-01"), ("new", "tip_amount", "2024-02-01")):
        kept[model_id] = train_and_score(priced, TLC, "linear", target, ["trip_distance"])
        save_model(kept[model_id], folder, model_id, "linear", target, ["trip_distance"], at)
    table = compare_models(saved_models(spark, folder)).collect()
    assert [r["model_id"] for r in table] == ["new", "old"]
    assert table[0]["n_train"] == kept["new"].train.count()
    described = saved_models(spark, folder).filter("model_id = 'old'").first()
    assert described["params"] == {"regParam": 0.0, "elasticNetParam": 0.0, "maxIter": 100.0}
    assert described["features"] == ["trip_distance"] and described["seconds"] > 0

    loaded = load_model(folder, "old")
    before = {r["VendorID"]: r["prediction"] for r in kept["old"].scored.collect()}
    again = {r["VendorID"]: r["prediction"] for r in score(loaded, kept["old"].test).collect()}
    assert before == again
    row = evaluate_saved(loaded, priced, TLC, "fare_amount").first()
    assert row["n"] == len(before)
    assert row["rmse"] == pytest.approx(0.0, abs=1e-6)


def test_report_of_a_saved_model(spark, priced):
    for key, names in (("linear", ["trip_distance", "RatecodeID"]), ("dtree", ["trip_distance", "RatecodeID"])):
        trained = train_and_score(priced, TLC, key, "fare_amount", names)
        found = evaluation_report(trained.model, priced, TLC, "fare_amount", names, ["VendorID"], rows=5)
        assert found.metrics.first()["n"] == trained.test.count()
        sample = found.sample.collect()
        assert len(sample) == 5 and all(r["error"] == pytest.approx(r["predicted"] - r["actual"]) for r in sample)
        ranked = found.importance.collect()
        assert [r["feature"] for r in ranked] == names and ranked[0]["importance"] > 10 * max(ranked[1]["importance"], 0)


def test_categories_are_split_as_sets(spark):
    """Three labels whose means no threshold on an index order can separate in one split."""
    means = {"a": 1.0, "b": 9.0, "c": 1.0}
    rows = [(k, means[k]) for k, n in (("a", 30), ("b", 20), ("c", 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "kind string, y double")
    model = fit(df, "dtree", "y", ["kind"], categories=["kind"], maxDepth=1)
    seen = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "kind string")
    got = {r["kind"]: r["prediction"] for r in score(model, seen).collect()}
    assert {k: got[k] for k in means} == means and got["new"] == got[None]
    assert score(model, seen).columns == ["kind", "prediction"]


def test_one_upcoming_trip(spark, priced):
    trained = train_and_score(priced, TLC, "linear", "fare_amount", model_features(TLC))
    moment = dt.datetime(2024, 5, 1, 8, 30)
    trip = spark.createDataFrame(
        [(moment, 50, 60, 10.0, 1.0, None)],
        f"{TLC.start} timestamp_ntz, {TLC.origin} int, {TLC.dest} int, {TLC.distance} double, "
        f"{TLC.party} double, {TLC.rate_code} double",
    )
    row = score_trips(trained.model, trip, TLC).first()
    assert row["prediction"] == pytest.approx(28.0, abs=0.01)


def test_ablation_compares_subsets(priced):
    subsets = {"one": ["trip_distance"], "raw": raw_features(TLC)}
    rows = {r["features"]: r for r in ablation(priced, TLC, "dtree", "fare_amount", subsets).collect()}
    assert set(rows) == {"one", "raw"}
    assert rows["raw"]["n_features"] == 5


def test_strings_indexed_by_frequency_then_value(spark):
    df = spark.createDataFrame([("N",), ("N",), ("Y",), ("A",)], "flag string")
    model = index_strings(df, "flag")
    unseen = spark.createDataFrame([("N",), ("A",), ("Y",), ("Z",)], "flag string")
    got = {r["flag"]: r["flag_idx"] for r in model.transform(unseen).collect()}
    assert got == {"N": 0.0, "A": 1.0, "Y": 2.0}


def test_partitions_of_a_fit_grow_slower_than_its_rows():
    assert [fit_partitions(n) for n in (0, 1, FIT_ROWS, FIT_ROWS + 1, 40 * FIT_ROWS)] == [1, 1, 1, 2, 40]
    assert [fit_partitions(n) for n in (1_300_000, 9_500_000, 57_000_000)] == [48, 48, 57]
    assert fit_partitions(10**11) == 10**5  # and hold a bounded number of rows


def test_the_fit_shuffles_no_more_than_its_columns(spark):
    rows = spark.range(1000).selectExpr("cast(id % 90 AS double) AS x", "cast(id AS double) AS y")
    arranged = _arranged(rows, 5)
    assert "Exchange hashpartitioning(xxhash64(" in arranged._jdf.queryExecution().executedPlan().toString()
    assert arranged.rdd.getNumPartitions() == 5 and sorted(arranged.collect()) == sorted(rows.collect())
    digest = F.xxhash64(*[x for c in rows.columns for x in (F.col(c).isNull(), F.col(c))])
    named = rows.withColumn("d", digest).repartition(5, "d").sortWithinPartitions("d").drop("d")
    assert arranged.collect() == named.collect()


def test_lines_are_joined_once_for_both_models(spark, monkeypatch):
    read = []
    monkeypatch.setattr(modelling, "derived_sales", lambda *a, f=modelling.derived_sales: read.append(a[2:]) or f(*a))
    assert modelling.compared(spark, "/root/testdata/sf0.001").count() == 2
    assert read == [("start_ts", "distance", "fare", "tip")]
    facts = modelling._line_model(spark, "/root/testdata/sf0.001").train
    assert "Join" not in facts._jdf.queryExecution().executedPlan().toString()


def test_a_model_does_not_depend_on_the_layout_of_its_rows(spark, priced):
    rows = priced.selectExpr("trip_distance AS x", "cast(PULocationID AS double) AS place", "fare_amount + tip_amount AS y")
    one, nine = (
        fit(rows.repartition(n, "x"), "rforest", "y", ["x", "place"], partition_rows=100, numTrees=4) for n in (1, 9)
    )
    assert one.stages[-1].toDebugString.split("\n", 1)[1] == nine.stages[-1].toDebugString.split("\n", 1)[1]


def test_best_splits_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1.0, 2.0, 5.0, None]), rng.gauss(0, 1), 7.0, rng.gauss(0, 1)) for _ in range(500)]
    rows = [(a, b, c, None if i % 50 == 0 else y + (3 if b > 0.4 else 0) - (a or 0)) for i, (a, b, c, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "few double, many double, one double, y double").repartition(4)
    got = {r["feature"]: r for r in best_splits(df, ["few", "many", "one"], "y", slices=7).collect()}
    assert set(got) == {"few", "many"}

    def error(values):
        return sum((v - sum(values) / len(values)) ** 2 for v in values) if values else 0.0

    for k, name in enumerate(["few", "many"]):
        known = [(r[k], r[3]) for r in rows if r[k] is not None and r[3] is not None]
        values = sorted({v for v, _ in known})
        sides = [(x + y) / 2 for x, y in zip(values, values[1:])]
        gains = {t: error([y for _, y in known]) - error([y for v, y in known if v <= t]) - error([y for v, y in known if v > t]) for t in sides}
        best = max(gains, key=lambda t: (gains[t], -t))
        r = got[name]
        assert (r["threshold"], r["n_left"]) == (best, sum(v <= best for v, _ in known))
        assert r["gain"] == pytest.approx(gains[best]) and r["n_left"] + r["n_right"] == len(known)
        assert split_gains(df, [name], "y", slices=3).count() == len(sides)


def test_partners_are_a_permutation_and_fixed_over_layouts(spark, monkeypatch):
    from wayfare.operators import importance

    monkeypatch.setattr(importance, "SLICE_ROWS", 40)
    rows = [(i, None if i % 9 == 0 else float(i % 13)) for i in range(300)]
    frame = spark.createDataFrame(rows, "i long, x double")
    pairs = [sorted(with_partners(frame.repartition(n), ["i", "x"]).collect()) for n in (2, 7)]
    assert pairs[0] == pairs[1]
    assert sorted(r["other"]["i"] for r in pairs[0]) == list(range(300))
    assert sum(r["other"]["i"] == r["i"] for r in pairs[0]) < 10


def test_permutation_importance_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.uniform(0, 10), rng.uniform(0, 10), rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, 3 * a + b + e) for a, b, e in rows], "a double, b double, y double")
    model = fit(df, "linear", "y", ["a", "b"])
    got = {r["feature"]: r["importance"] for r in permutation_importance(model, df, ["a", "b"], "y").collect()}
    pairs = with_partners(df.select("a", "b", F.col("y").alias("__label")), ["a", "b"]).collect()
    wa, wb = model.stages[-1].coefficients
    c = model.stages[-1].intercept

    def rmse(pick):
        return (sum((wa * pick(r)[0] + wb * pick(r)[1] + c - r["__label"]) ** 2 for r in pairs) / len(pairs)) ** 0.5

    base = rmse(lambda r: (r["a"], r["b"]))
    assert got["a"] == pytest.approx(rmse(lambda r: (r["other"]["a"], r["b"])) - base)
    assert got["b"] == pytest.approx(rmse(lambda r: (r["a"], r["other"]["b"])) - base)
    assert got["a"] > 2 * got["b"] > 0
