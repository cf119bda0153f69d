"""Model fits, evaluation, persistence and scoring.

One-feature linear fits, single splits and one round of boosting have closed forms in SQL and are checked exactly; of larger tree ensembles SQL
states bounds, and the test suite checks them on data with a known answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wayfare.catalog.cleaning import derived_rides, derived_sales
from wayfare.catalog.registry import SALES_CUTOFF, SALES_KEEP, query, sql_with
from wayfare.operators.aggregates import row_count
from wayfare.operators.cleaning import keep_rows, standard_rules
from wayfare.operators.evaluation import (
    PREDICTION,
    prediction_sample,
    regression_metrics,
    residual_histogram,
)
from wayfare.operators.features import model_features, raw_features
from wayfare.operators.importance import permutation_importance
from wayfare.operators.split import column_means, resolved_split, time_split
from wayfare.operators.splits import best_splits
from wayfare.plans.boosting import Settings, fit_boosted, score_boosted
from wayfare.plans.models import (
    Trained,
    ablation,
    coefficients,
    compare_models,
    evaluate_saved,
    evaluation_report,
    feature_importance,
    fit,
    index_strings,
    load_model,
    save_model,
    saved_models,
    score,
    score_trips,
    stored_frame,
    train_and_score,
)
from wayfare.sources.sinks import shared_folder, stored
from wayfare.sources.tables import SALES, SALES_LIMITS, sales


def clean_sales(spark, folder):
    return keep_rows(derived_sales(spark, folder), standard_rules(SALES, SALES_LIMITS))


# One feature, so that SQL can state the same least-squares line
_LINE = ["distance"]
_DATED = f"""dated AS (
  SELECT *, CAST(start_ts AS DATE) < {SALES_CUTOFF} AS train FROM sales
)"""
_FITTED = f""", {_DATED}, line AS (
  SELECT regr_slope(fare, distance) AS slope, regr_intercept(fare, distance) AS icept
  FROM dated WHERE train
)"""


def _line_facts(spark, folder, *targets):
    """The dated columns that lines are fitted on, stored: the cutoff, the fit, the scoring and the counts would each join lines to orders again."""
    return stored(derived_sales(spark, folder, "start_ts", *_LINE, *targets).drop("start_ts"), "line-rows")


def _line_model(spark, folder, target="fare", facts=None):
    train, test = resolved_split(_line_facts(spark, folder, target) if facts is None else facts, 0.2)
    model = fit(train, "linear", target, _LINE)
    return Trained(model, train, test, score(model, test))


@query(
    "ml.linear",
    sql_with(
        "sales",
        then=_FITTED
        + """
        SELECT 'distance' AS term, round(slope, 6) AS coefficient FROM line
        UNION ALL SELECT 'intercept', round(icept, 6) FROM line""",
    ),
)
def linear(spark, folder):
    return coefficients(_line_model(spark, folder).model, spark, _LINE)


@query(
    "score_batch",
    sql_with(
        "sales",
        then=_FITTED
        + """
        SELECT order_key, line_number, distance, round(icept + slope * distance, 4) AS prediction
        FROM sales, line""",
    ),
    digits=4,
)
def score_batch(spark, folder):
    model = _line_model(spark, folder).model
    facts = sales(spark, folder, "order_key", "line_number", "distance")
    return score(model, facts)


_METRICS = """
  count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
  round(1 - avg(e * e) / var_pop(y), 6) AS r2"""
_LINE_METRICS = f"""
  SELECT {_METRICS} FROM (SELECT icept + slope * distance - fare AS e, fare AS y
                          FROM dated, line WHERE NOT train)"""


def _rounded(metrics):
    return metrics.select("n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae")], "r2")


@query("eval.linear", sql_with("sales", then=_FITTED + _LINE_METRICS))
def linear_metrics(spark, folder):
    return _rounded(regression_metrics(_line_model(spark, folder).scored, "fare"))


@query("eval.saved", sql_with("sales", then=_FITTED + _LINE_METRICS))
def saved_metrics(spark, folder):
    base = shared_folder(spark, "models")
    _save(_line_model(spark, folder), base, "line", "fare", "2024-01-01T00:00:00")
    return _rounded(evaluate_saved(load_model(base, "line"), sales(spark, folder), SALES, "fare"))


def _save(trained, base, model_id, target, trained_at):
    save_model(trained, base, model_id, "linear", target, _LINE, trained_at)


@query(
    "model_roundtrip",
    sql_with(
        "sales",
        then=_FITTED
        + """
        SELECT count(*) AS n, 0 AS changed, round(avg(icept + slope * distance), 4) AS avg_prediction
        FROM sales, line""",
    ),
    digits=4,
)
def roundtrip(spark, folder):
    base = shared_folder(spark, "models")
    trained = _line_model(spark, folder)
    _save(trained, base, "line", "fare", "2024-01-01T00:00:00")
    before = score(trained.model, sales(spark, folder, "distance")).withColumnRenamed(PREDICTION, "before")
    both = score(load_model(base, "line"), before)
    changed = F.count_if(F.col("before") != F.col(PREDICTION)).cast("int")
    return both.agg(
        row_count().alias("n"), changed.alias("changed"), F.avg(PREDICTION).alias("avg_prediction")
    )


def _compare_sql(model_id: str, target: str, trained_at: str) -> str:
    return f"""
      SELECT '{model_id}' AS model_id, 'Linear Regression' AS model_name, '{target}' AS target,
             round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae,
             round(1 - avg(e * e) / var_pop(y), 4) AS r2,
             (SELECT count(*) FROM dated WHERE train) AS n_train, '{trained_at}' AS trained_at
      FROM (SELECT i + s * distance - {target} AS e, {target} AS y FROM dated,
            (SELECT regr_slope({target}, distance) AS s, regr_intercept({target}, distance) AS i
             FROM dated WHERE train) WHERE NOT train)"""


@query(
    "model_compare",
    sql_with(
        "sales",
        then=f", {_DATED}"
        + _compare_sql("fare-line", "fare", "2024-01-01T00:00:00")
        + " UNION ALL "
        + _compare_sql("tip-line", "tip", "2024-02-01T00:00:00"),
    ),
)
def compared(spark, folder):
    base, facts = shared_folder(spark, "models"), _line_facts(spark, folder, "fare", "tip")
    for model_id, target, at in (
        ("fare-line", "fare", "2024-01-01T00:00:00"),
        ("tip-line", "tip", "2024-02-01T00:00:00"),
    ):
        _save(_line_model(spark, folder, target, facts), base, model_id, target, at)
    return compare_models(saved_models(spark, base))


# Evaluation of the training-mean predictor


def _baseline(df, target):
    train, test = time_split(df, 0.2)
    return test.withColumn(PREDICTION, column_means(train, [target]).scalar())


_MEAN = f", {_DATED}, guess AS (SELECT avg(fare) AS p FROM dated WHERE train)"


@query(
    "eval.metrics",
    sql_with(
        "sales",
        then=_MEAN + f" SELECT {_METRICS} FROM (SELECT p - fare AS e, fare AS y FROM dated, guess WHERE NOT train)",
    ),
)
def baseline_metrics(spark, folder):
    facts = derived_sales(spark, folder, "start_ts", "end_ts", "fare")
    return _rounded(regression_metrics(_baseline(facts, "fare"), "fare"))


@query(
    "eval.residual_hist",
    sql_with(
        "sales",
        then=_MEAN
        + """
        SELECT CAST(least(floor((least(greatest(p - fare, -60000.0::DOUBLE), 60000.0::DOUBLE) + 60000.0::DOUBLE)
                                / 3000.0::DOUBLE) + 1, 40) AS INTEGER) AS bin, count(*) AS rows
        FROM dated, guess WHERE NOT train GROUP BY 1""",
    ),
)
def baseline_residuals(spark, folder):
    facts = derived_sales(spark, folder, "start_ts", "end_ts", "fare")
    return residual_histogram(_baseline(facts, "fare"), "fare", -60000.0, 60000.0)


@query(
    "eval.sample",
    sql_with(
        "rides",
        then="""
        , cut AS (SELECT quantile_disc(CAST(start_ts AS DATE), 0.8) AS d FROM rides),
          guess AS (SELECT avg(fare) AS p FROM rides, cut WHERE CAST(start_ts AS DATE) < d)
        SELECT event_id, fare AS actual, round(p, 6) AS predicted, round(p - fare, 6) AS error
        FROM rides, cut, guess WHERE CAST(start_ts AS DATE) >= d
        ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 200""",
    ),
)
def baseline_sample(spark, folder):
    facts = derived_rides(spark, folder, "event_id", "start_ts", "end_ts", "fare")
    return prediction_sample(_baseline(facts, "fare"), "fare", "event_id")


# String indexing


@query(
    "string_index",
    """WITH counts AS (SELECT l_returnflag AS flag, count(*) AS rows FROM lineitem GROUP BY 1)
       SELECT flag, CAST(row_number() OVER (ORDER BY rows DESC, flag) - 1 AS DOUBLE) AS flag_idx, rows
       FROM counts""",
)
def string_index(spark, folder):
    facts = sales(spark, folder, "flag")
    indexed = index_strings(facts, "flag").transform(facts)
    return indexed.groupBy("flag", "flag_idx").agg(row_count().alias("rows"))


# Fits over all 16 features, trees included: what SQL can state of them is how many rows they score, that they fit no worse than the
# train mean, and bounds of what they return.

_HELD_OUT = f""" , kept AS (SELECT * FROM sales_d WHERE {SALES_KEEP}),
  cut AS (SELECT quantile_disc(start_date, 0.8) AS d FROM kept)"""


def _full_fit(spark, folder, key, target="fare", features=None, **params):
    features = features or model_features(SALES)
    return train_and_score(clean_sales(spark, folder), SALES, key, target, features, **params)


def _against_mean(trained, target: str):
    """(n, no_worse): held-out rows scored, and whether the error on the training rows is no larger than that of their mean."""
    train = trained.train.filter(F.col(target).isNotNull())
    mean = column_means(train, [target]).scalar()
    measured = score(trained.model, train).agg(
        F.avg((F.col(PREDICTION) - F.col(target)) ** 2).alias("own"), F.avg((mean - F.col(target)) ** 2).alias("mean")
    )
    fits = measured.select(F.col("own") <= F.col("mean") * (1 + 1e-9)).scalar()
    return trained.scored.agg(row_count().alias("n")).select("n", fits.alias("no_worse"))


def _register_fit(name: str, key: str, target: str = "fare", extra: tuple[str, ...] = ()):
    sql = f" SELECT '{key}' AS model, count(*) AS n, true AS no_worse FROM kept, cut WHERE start_date >= d AND {target} IS NOT NULL"

    @query(name, sql_with("sales", "sales_d", then=_HELD_OUT + sql))
    def run(spark, folder):
        features = [*model_features(SALES), *extra]
        trained = _full_fit(spark, folder, key, target, features)
        return _against_mean(trained, target).withColumn("model", F.lit(key))


_register_fit("ml.linear_full", "linear")
_register_fit("ml.dtree", "dtree")
_register_fit("ml.rforest", "rforest")
_register_fit("ml.gbt", "gbt")
_register_fit("ml.boosted", "boosted")
_register_fit("ml.duration", "dtree", target="duration_min")
# The tip model may also see the fare; it is evaluated against the tip it predicts.
_register_fit("ml.tip", "dtree", target="tip", extra=("fare",))

# Eight columns, of which one holds strings.
_INDEXED = ["flag", *raw_features(SALES), "line_number", "pickup_month"]
_SUBSETS = {"distance_and_rate": 2, "indexed": len(_INDEXED), "raw": len(raw_features(SALES)), "engineered": len(model_features(SALES))}


@query(
    "ml.ablation",
    sql_with(
        "sales",
        "sales_d",
        then=_HELD_OUT
        + " UNION ALL ".join(
            f" SELECT '{name}' AS features, {n} AS n_features, count(*) AS n, true AS bounded FROM kept, cut WHERE start_date >= d"
            for name, n in _SUBSETS.items()
        ),
    ),
)
def ablated(spark, folder):
    """Each subset's metrics, reduced to what SQL can state: all held-out rows, and errors that fit each other."""
    subsets = {
        "distance_and_rate": [SALES.distance, SALES.rate_code],
        "indexed": _INDEXED,
        "raw": raw_features(SALES),
        "engineered": model_features(SALES),
    }
    table = ablation(clean_sales(spark, folder), SALES, "dtree", "fare", subsets, categories=["flag"])
    bounded = (F.col("mae") > 0) & (F.col("mae") <= F.col("rmse")) & (F.col("r2") < 1)
    return table.select("features", "n_features", "n", bounded.alias("bounded"))


@query(
    "eval.importance",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS share, true AS adds_up" for f in model_features(SALES)),
)
def importance(spark, folder):
    """Every feature's importance is a share and they add up to one."""
    trained = _full_fit(spark, folder, "dtree")
    found = feature_importance(trained.model, spark, model_features(SALES))
    total = found.agg(F.sum("importance")).scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("share"), (F.abs(total - 1) < 1e-9).alias("adds_up"))


@query("score_trips", sql_with("sales", then=" SELECT order_key, line_number, true AS in_range FROM sales"))
def score_all_trips(spark, folder):
    """Every sale, described only by what is known before it ends: its prediction is a mean of training fares."""
    trained = _full_fit(spark, folder, "dtree")
    known = [SALES.start, SALES.origin, SALES.dest, SALES.distance, SALES.party, SALES.rate_code]
    upcoming = sales(spark, folder, "order_key", "line_number", *known)
    low, high = (trained.train.agg(f("fare")).scalar() for f in (F.min, F.max))
    scored = score_trips(trained.model, upcoming, SALES)
    return scored.select("order_key", "line_number", F.col(PREDICTION).between(low, high).alias("in_range"))


# Splits that SQL finds by prefix sums over the counts of distinct values

_SPLIT_FEATURES = ["distance", "party", "rate_code", "origin_id", "dest_id"]


def _splits_sql(features: list[str], source: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, fare AS y FROM {source}" for f in features)
    return f"""
  counts AS (
    SELECT feature, value, count(*) AS n, sum(y) AS total FROM ({cells}) WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
  sides AS (
    SELECT feature, value, lead(value) OVER w AS after, sum(n) OVER w AS n_left, sum(total) OVER w AS t_left,
           sum(n) OVER f AS n_all, sum(total) OVER f AS t_all
    FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
  gains AS (
    SELECT feature, (value + after) / 2 AS threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n_all - n_left AS BIGINT) AS n_right,
           t_left / n_left AS left_mean, (t_all - t_left) / (n_all - n_left) AS right_mean,
           n_left * (t_left / n_left - t_all / n_all) ** 2
             + (n_all - n_left) * ((t_all - t_left) / (n_all - n_left) - t_all / n_all) ** 2 AS gain
    FROM sides WHERE after IS NOT NULL)"""


@query(
    "ml.best_split",
    sql_with("sales", then=f", {_splits_sql(_SPLIT_FEATURES, 'sales')}")
    + """
  SELECT feature, threshold, n_left, n_right, round(left_mean, 4) AS left_mean, round(right_mean, 4) AS right_mean, round(gain / 1e9, 4) AS gain
  FROM gains QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1""",
    digits=4,
)
def exact_splits(spark, folder):
    found = best_splits(sales(spark, folder, "fare", *_SPLIT_FEATURES), _SPLIT_FEATURES, "fare")
    return found.withColumn("gain", F.col("gain") / 1e9)


def _stump_sql(features: list[str]) -> str:
    return sql_with(
        "sales",
        then=f""", filled AS (SELECT * REPLACE (coalesce(rate_code, 1.0) AS rate_code) FROM sales WHERE fare IS NOT NULL), {_splits_sql(features, "filled")},
  best AS (SELECT * FROM gains ORDER BY gain DESC, feature, threshold LIMIT 1)
  SELECT round(left_mean, 4) AS prediction, n_left AS rows FROM best UNION ALL SELECT round(right_mean, 4), n_right FROM best""",
    )


def _stump(spark, folder, key: str, features: list[str], **params):
    """The leaves of one split over all rows, as (prediction, rows)."""
    facts = sales(spark, folder, "fare", *features).fillna({SALES.rate_code: 1.0})
    model = fit(facts, key, "fare", features, **params)
    return score(model, facts).groupBy(PREDICTION).agg(row_count().alias("rows"))


@query("ml.dtree.stump", _stump_sql(_SPLIT_FEATURES), digits=4)
def tree_of_one_split(spark, folder):
    """As many bins as the features have values, so that the fit weighs every split."""
    return _stump(spark, folder, "dtree", _SPLIT_FEATURES, maxDepth=1, maxBins=64)


@query(
    "ml.categories",
    sql_with(
        "sales",
        then="""
        SELECT coalesce(flag, '-') AS flag, count(*) AS rows, true AS known_means FROM sales GROUP BY 1""",
    ),
)
def categories(spark, folder):
    """A tree over one string column, fitted without one of its values, saved, loaded, and scoring all rows, the unseen value's too."""
    facts = sales(spark, folder, "order_key", "flag", "fare")
    seen = facts.filter("flag != 'A' AND fare IS NOT NULL")
    base = shared_folder(spark, "models")
    model = fit(seen, "dtree", "fare", ["flag"], categories=["flag"], maxDepth=2)
    model.write().overwrite().save(f"{base}/categories")
    scored = score(PipelineModel.load(f"{base}/categories"), facts)
    means = seen.groupBy("flag").agg(F.avg("fare").alias("m"))
    low, high = means.agg(F.min("m")).scalar(), means.agg(F.max("m")).scalar()
    within = F.col(PREDICTION).between(low - 1e-6, high + 1e-6)
    return scored.groupBy(F.coalesce("flag", F.lit("-")).alias("flag")).agg(row_count().alias("rows"), F.bool_and(within).alias("known_means"))


@query(
    "eval.report",
    sql_with(
        "sales",
        then=_FITTED
        + f""", figures AS ({_LINE_METRICS})
        SELECT 'metrics' AS section, 'n' AS subject, CAST(n AS DOUBLE) AS value FROM figures
        UNION ALL SELECT 'metrics', 'rmse', rmse FROM figures UNION ALL SELECT 'metrics', 'mae', mae FROM figures
        UNION ALL SELECT 'metrics', 'r2', round(r2, 4) FROM figures
        UNION ALL SELECT 'sample', 'rows', CAST(least(200, n) AS DOUBLE) FROM figures
        UNION ALL SELECT 'importance', 'distance', 1.0""",
    ),
    digits=4,
)
def report(spark, folder):
    """A saved line evaluated again: metrics, how many predictions the sample has, and whether its one feature matters."""
    base = shared_folder(spark, "models")
    _save(_line_model(spark, folder), base, "line", "fare", "2024-01-01T00:00:00")
    found = evaluation_report(load_model(base, "line"), sales(spark, folder), SALES, "fare", _LINE, ["order_key", "line_number"])
    metrics = found.metrics.withColumn("n", F.col("n").cast("double")).unpivot([], ["n", "rmse", "mae", "r2"], "subject", "value")
    sample = found.sample.agg(row_count().cast("double").alias("value")).select(F.lit("rows").alias("subject"), "value")
    weight = found.importance.select(F.col("feature").alias("subject"), (F.col("importance") > 0).cast("double").alias("value"))
    parts = {"metrics": metrics, "sample": sample, "importance": weight}
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("section"), "subject", "value") for name, df in parts.items()])


_FEW_VALUES = ["party", "rate_code", "origin_id", "dest_id"]


@query("ml.gbt.stump", _stump_sql(_FEW_VALUES), digits=4)
def one_round_of_boosting(spark, folder):
    return _stump(spark, folder, "gbt", _FEW_VALUES, maxIter=1, maxDepth=1)


@query("ml.boosted.stump", _stump_sql(_FEW_VALUES), digits=4)
def one_boosted_split(spark, folder):
    """One round of the second-order boosting with no shrinkage and no penalty is the best split."""
    facts = sales(spark, folder, "fare", *_FEW_VALUES).fillna({SALES.rate_code: 1.0})
    settings = Settings(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0)
    scored = score_boosted(fit_boosted(facts, _FEW_VALUES, "fare", settings), facts)
    return scored.groupBy(PREDICTION).agg(row_count().alias("rows"))


_ROUNDS = 10


@query(
    "ml.boosted.second_order",
    sql_with("sales", "sales_d", then=_HELD_OUT + " SELECT count(*) AS n, true AS beats_gbt, true AS kept_best FROM kept, cut WHERE start_date >= d"),
)
def second_order(spark, folder):
    """As many rounds of depth 5 as Spark's own boosting: the error on the hold-out is no larger. The last weeks of training decide where to stop."""
    features = model_features(SALES)
    train, test = resolved_split(stored_frame(clean_sales(spark, folder), SALES, "fare"), 0.2)
    weeks = train.select((F.max("start_date") - F.expr("INTERVAL 28 DAYS")).alias("d")).scalar()
    own = fit_boosted(train, features, "fare", Settings(n_estimators=_ROUNDS, max_depth=5, patience=3), F.col("start_date") > weeks)
    other = fit(train, "gbt", "fare", features, maxIter=_ROUNDS)
    off = (F.col(PREDICTION) - F.col("fare")) ** 2
    ours = score_boosted(own, test).agg(row_count().alias("n"), F.sqrt(F.avg(off)).alias("rmse"))
    theirs = score(other, test).agg(F.sqrt(F.avg(off)).alias("rmse")).scalar()
    return ours.select("n", (F.col("rmse") <= theirs).alias("beats_gbt"), F.lit(0 < len(own.trees) <= _ROUNDS).alias("kept_best"))


@query(
    "eval.permutation",
    """SELECT 'fare' AS feature, true AS matters UNION ALL SELECT 'party', false UNION ALL SELECT 'constant', false""",
)
def permuted(spark, folder):
    """A line to the tip, of which the fare is a factor, and a hardly related number and a constant: only the first can matter to it."""
    facts = sales(spark, folder, "tip", "fare", "party").withColumn("constant", F.lit(1.0))
    names = ["fare", "party", "constant"]
    found = permutation_importance(fit(facts, "linear", "tip", names), facts, names, "tip")
    spread = facts.agg(F.stddev("tip")).scalar()
    return found.select("feature", (F.col("importance") > 0.05 * spread).alias("matters"))
