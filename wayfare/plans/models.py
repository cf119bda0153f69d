"""Regression models: registry, fitting, scoring, persistence, comparison.

All fits are distributed Spark ML fits; no training row reaches the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.sampling import cap_rows
from wayfare.operators.cleaning import prepare_frame
from wayfare.operators.evaluation import PREDICTION, prediction_sample, regression_metrics
from wayfare.operators.features import basic_features
from wayfare.operators.importance import permutation_importance
from wayfare.operators.split import resolved_split
from wayfare.plans.binned import fit_binned
from wayfare.roles import Roles
from wayfare.sources.schemas import columns
from wayfare.sources.sinks import stored

FEATURES = "features"
SEED = 42


class Param(NamedTuple):
    """One tunable: the Spark ML parameter it sets, its default and allowed range."""

    sets: str
    default: float
    low: float
    high: float

    def checked(self, name: str, value: float) -> float:
        if not self.low <= value <= self.high:
            raise ValueError(f"{name}={value} is outside {self.low}..{self.high}")
        return type(self.default)(value)


class Learner(NamedTuple):
    name: str
    estimator: Callable[..., Estimator]
    params: Mapping[str, Param]
    seeded: bool = True
    binned: bool = False  # fitted by fit_binned where all features are numbers

    def build(self, label: str, **values: float) -> Estimator:
        unknown = set(values) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)}")
        settings = {
            p.sets: p.checked(name, values.get(name, p.default)) for name, p in self.params.items()
        }
        if self.seeded:
            settings["seed"] = SEED
        return self.estimator(
            featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, **settings
        )


_DEPTH = Param("maxDepth", 5, 1, 30)
# Names, defaults and ranges of the hyper-parameters. ``boosted`` is an alias: the same learner as ``gbt`` under the parameter
# names that gradient-boosting libraries use. Its hundred trees are fitted by passes over stored bins.
MODELS: dict[str, Learner] = {
    "linear": Learner(
        "Linear Regression",
        LinearRegression,
        {
            "regParam": Param("regParam", 0.0, 0.0, 1.0),
            "elasticNetParam": Param("elasticNetParam", 0.0, 0.0, 1.0),
            "maxIter": Param("maxIter", 100, 1, 1000),
        },
        seeded=False,
    ),
    "dtree": Learner("Decision Tree Regressor", DecisionTreeRegressor, {"maxDepth": _DEPTH, "maxBins": Param("maxBins", 32, 2, 256)}),
    "rforest": Learner(
        "Random Forest Regressor",
        RandomForestRegressor,
        {"numTrees": Param("numTrees", 20, 1, 200), "maxDepth": _DEPTH, "subsamplingRate": Param("subsamplingRate", 1.0, 0.1, 1.0)},
    ),
    "gbt": Learner(
        "GBT Regressor",
        GBTRegressor,
        {"maxIter": Param("maxIter", 20, 1, 200), "maxDepth": _DEPTH, "stepSize": Param("stepSize", 0.1, 0.01, 1.0)},
    ),
    "boosted": Learner(
        "Boosted Trees Regressor",
        GBTRegressor,
        {
            "n_estimators": Param("maxIter", 100, 10, 1000),
            "max_depth": Param("maxDepth", 6, 2, 15),
            "learning_rate": Param("stepSize", 0.3, 0.01, 1.0),
            "subsample": Param("subsamplingRate", 1.0, 0.1, 1.0),
        },
        binned=True,
    ),
}


def model_frame(df: DataFrame, roles: Roles, target: str) -> DataFrame:
    """Row features with the rate code filled and no missing target."""
    return prepare_frame(basic_features(df, roles), roles, target)


def stored_frame(df: DataFrame, roles: Roles, target: str) -> DataFrame:
    """:func:`model_frame` written once, for the cutoff, the fit and the scoring that all read it.

    Computed lazily it would repeat the joins and the cleaning behind ``df`` for each of them.
    """
    return stored(model_frame(df, roles, target), "model-rows")


# Rows of a partition that a fit reads; once there are FIT_PARTITIONS, partitions grow up to GROWN times that before more are made. Every level of every tree
# is a job that sends a result a partition to the driver, so their number must not keep up with the rows. It depends on the rows alone, so that neither
# the cluster nor the input's layout changes the model.
FIT_ROWS = 25_000
FIT_PARTITIONS = 48
GROWN = 40


def fit_partitions(rows: int, partition_rows: int = FIT_ROWS) -> int:
    few = min(-(-rows // partition_rows), FIT_PARTITIONS)
    return max(1, few, -(-rows // (partition_rows * GROWN)))


def _arranged(rows: DataFrame, partitions: int) -> DataFrame:
    """The same rows in the same order and partitions, however they arrive: both by a hash of their contents.

    Tree learners sample bins and rows by partition and place, and sums of doubles depend on their order.
    """
    digest = F.xxhash64(*[x for c in rows.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    return rows.repartition(partitions, digest).sortWithinPartitions(digest)  # not as a column, which would be shuffled too


def fit(
    train: DataFrame, key: str, label: str, features: list[str], categories: list[str] = (), partition_rows: int = FIT_ROWS, **params: float
) -> PipelineModel:
    """Assemble ``features`` and fit the registered model.

    ``categories`` are those of the features that hold strings. They are indexed inside the pipeline, by descending frequency, and keep their attribute
    metadata in the vector, so that trees split them as sets of values; values not seen while fitting, and NULL, share one more index, and
    their rows are scored like all others. A tree needs as many bins as a category has values and one more.

    A NULL or NaN feature fails the fit instead of silently poisoning it. The few columns
    the fit reads are dealt by their hash to :func:`fit_partitions`, and kept on the executors,
    with spilling; a lost block is recomputed from the source. The rows are counted first.

    ``boosted`` on numeric features gives the model that Spark's boosting would give of these rows, but for the rounding of sums, by :func:`fit_binned`.
    """
    narrow = train.select(*dict.fromkeys([*features, label]))
    n = narrow.count()
    partitions = fit_partitions(n, partition_rows)
    rows = _arranged(narrow, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexed = [StringIndexer(inputCol=c, outputCol=_index(c), handleInvalid="keep", stringOrderType="frequencyDesc") for c in categories]
        inputs = [_index(f) if f in categories else f for f in features]
        assembler = VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error")
        estimator = MODELS[key].build(label, **params)
        if MODELS[key].binned and not categories:
            return PipelineModel([assembler, fit_binned(rows, n, partitions, features, estimator)])
        return Pipeline(stages=[*indexed, assembler, estimator]).fit(rows)
    finally:
        rows.unpersist()


def _index(column: str) -> str:
    return f"{column}_idx"


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """All rows and columns of ``df`` plus the prediction."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], PREDICTION)


def score_trips(model: PipelineModel, df: DataFrame, roles: Roles) -> DataFrame:
    """Predictions for raw trips that have not ended: features as in training, then score."""
    ready = basic_features(df, roles).fillna({roles.rate_code: 1.0})
    return score(model, ready).select(*df.columns, PREDICTION)


def index_strings(df: DataFrame, *columns: str) -> PipelineModel:
    """Fitted indexer ``<column>_idx``: 0 for the most frequent value, ties by value.

    Rows with a value not seen while fitting are skipped when it is applied.
    """
    indexer = StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}_idx" for c in columns],
        handleInvalid="skip",
        stringOrderType="frequencyDesc",
    )
    return Pipeline(stages=[indexer]).fit(df)


def coefficients(model: PipelineModel, spark: SparkSession, features: list[str]) -> DataFrame:
    """(term, coefficient) of a fitted linear model."""
    linear = model.stages[-1]
    terms = zip([*features, "intercept"], [*linear.coefficients, linear.intercept], strict=True)
    return spark.createDataFrame([(t, float(c)) for t, c in terms], "term string, coefficient double")


def feature_importance(
    model: PipelineModel, spark: SparkSession, features: list[str], top: int | None = None
) -> DataFrame | None:
    """(feature, importance), largest first; None for a model that has none."""
    weights = getattr(model.stages[-1], "featureImportances", None)
    if weights is None:
        return None
    rows = [(name, float(weights[i])) for i, name in enumerate(features)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    ranked = table.orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


class Trained(NamedTuple):
    model: PipelineModel
    train: DataFrame
    test: DataFrame
    scored: DataFrame
    seconds: float | None = None  # that the fit took


def train_and_score(
    df: DataFrame,
    roles: Roles,
    key: str,
    target: str,
    features: list[str],
    test_fraction: float = 0.2,
    max_rows: int | None = None,
    keys: list[str] = (),
    categories: list[str] = (),
    **params: float,
) -> Trained:
    """Features, time split, fit on the past, predictions for the held-out future.

    ``max_rows`` thins the training part to about that many rows, chosen by the hash of
    ``keys``; the hold-out is always scored whole.
    """
    train, test = resolved_split(stored_frame(df, roles, target), test_fraction)
    if max_rows is not None:
        train = cap_rows(train, max_rows, *keys)
    began = time.monotonic()
    model = fit(train, key, target, features, categories, **params)
    return Trained(model, train, test, score(model, test), time.monotonic() - began)


def evaluate_saved(
    model: PipelineModel, df: DataFrame, roles: Roles, target: str, test_fraction: float = 0.2
) -> DataFrame:
    """Metrics of a loaded model on the hold-out rebuilt from ``df``."""
    _, test = resolved_split(stored_frame(df, roles, target), test_fraction)
    return regression_metrics(score(model, test), target)


class Evaluation(NamedTuple):
    metrics: DataFrame
    sample: DataFrame
    importance: DataFrame


def evaluation_report(
    model: PipelineModel, df: DataFrame, roles: Roles, target: str, features: list[str], keys: list[str], test_fraction: float = 0.2, rows: int = 200
) -> Evaluation:
    """A saved model on the hold-out rebuilt from ``df``: metrics, a sample of predictions by the hash of ``keys``, and importances.

    The importances are the trees' own where the model has any, else by permutation on the hold-out, which needs numeric ``features``. The scored
    hold-out is stored, so the three do not score it again.
    """
    _, test = resolved_split(stored_frame(df, roles, target), test_fraction)
    scored = stored(score(model, test), "scored")
    own = feature_importance(model, df.sparkSession, features)
    ranked = own if own is not None else permutation_importance(model, scored, features, target)
    return Evaluation(regression_metrics(scored, target), prediction_sample(scored, target, *keys, rows=rows), ranked)


def ablation(
    df: DataFrame, roles: Roles, key: str, target: str, subsets: Mapping[str, list[str]], categories: list[str] = (), **params: float
) -> DataFrame:
    """(features, n_features, n, rmse, mae, r2): one fit per feature subset; ``categories`` are the string features of any of them."""
    train, test = resolved_split(stored_frame(df, roles, target), 0.2)
    table = None
    for name, features in subsets.items():
        own = [c for c in categories if c in features]
        scored = score(fit(train, key, target, features, own, **params), test)
        row = regression_metrics(scored, target).select(
            F.lit(name).alias("features"), F.lit(len(features)).alias("n_features"), "*"
        )
        table = row if table is None else table.unionByName(row)
    return table


# Persistence

METADATA = columns(
    model_id=T.StringType(),
    model_key=T.StringType(),
    model_name=T.StringType(),
    target=T.StringType(),
    params=T.MapType(T.StringType(), T.DoubleType()),
    features=T.ArrayType(T.StringType()),
    rmse=T.DoubleType(),
    mae=T.DoubleType(),
    r2=T.DoubleType(),
    n_train=T.LongType(),
    n_test=T.LongType(),
    trained_at=T.StringType(),
    seconds=T.DoubleType(),
)


def save_model(
    trained: Trained,
    folder: str,
    model_id: str,
    key: str,
    target: str,
    features: list[str],
    trained_at: str,
    **params: float,
) -> None:
    """Write the fitted pipeline and its one-row metadata under ``folder/model_id``."""
    trained.model.write().overwrite().save(f"{folder}/{model_id}/pipeline")
    described = regression_metrics(trained.scored, target).select(
        F.lit(model_id).alias("model_id"),
        F.lit(key).alias("model_key"),
        F.lit(MODELS[key].name).alias("model_name"),
        F.lit(target).alias("target"),
        _settings(key, params).alias("params"),
        F.array(*map(F.lit, features)).alias("features"),
        "rmse",
        "mae",
        "r2",
        trained.train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
        F.col("n").alias("n_test"),
        F.lit(trained_at).alias("trained_at"),
        F.lit(trained.seconds).cast("double").alias("seconds"),
    )
    described.coalesce(1).write.mode("overwrite").json(f"{folder}/{model_id}/meta")


def _settings(key: str, params: Mapping[str, float]):
    values = {n: float(params.get(n, p.default)) for n, p in MODELS[key].params.items()}
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def load_model(folder: str, model_id: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{model_id}/pipeline")


def saved_models(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of every saved model, newest first; empty when there is none."""
    try:
        found = spark.read.schema(METADATA).json(f"{folder}/*/meta")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], METADATA)
    return found.orderBy(F.desc("trained_at"), "model_id")


def compare_models(saved: DataFrame) -> DataFrame:
    """The comparison table: metrics rounded for reading, newest first."""
    return saved.orderBy(F.desc("trained_at"), "model_id").select(
        "model_id",
        "model_name",
        "target",
        F.round("rmse", 3).alias("rmse"),
        F.round("mae", 3).alias("mae"),
        F.round("r2", 4).alias("r2"),
        "n_train",
        "trained_at",
    )
