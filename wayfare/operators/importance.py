"""Permutation importance: how much worse a model predicts when one feature's values are dealt to other rows.

Rows are matched to partners by rank in two hash orders of their contents. Ranks are counted in slices of the hash range, with the slices' sizes added up, so there
is no global sort and no window over more than about ``SLICE_ROWS`` rows (of different contents). The hashes depend on contents alone: any layout of the table gives the
same partners, up to rows equal in everything.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.sinks import stored

SLICE_ROWS = 100_000


def _ranked(rows: DataFrame, columns: list[str], seed: int, slices: int) -> DataFrame:
    """``rows`` with ``rank``, from 0, by a hash of ``columns``."""
    digest = F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    part = F.floor((digest.cast("double") / 2.0**64 + 0.5) * slices).cast("int")
    placed = rows.withColumns({"__h": digest, "__slice": F.least(F.greatest(part, F.lit(0)), F.lit(slices - 1))})
    sizes = placed.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    starts = sizes.select("__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__slice").orderBy("__h", *columns)
    return placed.join(F.broadcast(starts), "__slice").withColumn("rank", F.col("__first") + F.row_number().over(inside) - 1).drop("__h", "__slice", "__first")


def with_partners(rows: DataFrame, columns: list[str], seed: int = 1) -> DataFrame:
    """``rows`` with ``other``, a struct of ``columns`` of the row at the same place in another order; every row is partner of one."""
    held = stored(rows, "permuted")
    slices = max(1, -(-held.count() // SLICE_ROWS))
    one = _ranked(held, held.columns, 2 * seed, slices)
    other = _ranked(held, held.columns, 2 * seed + 1, slices).select(F.col("rank"), F.struct(*columns).alias("other"))
    return one.join(other, "rank").drop("rank")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str, seed: int = 1) -> DataFrame:
    """(feature, importance), largest first: the rise of the RMSE on ``df`` when the feature comes from each row's partner.

    Works for any fitted regressor of :mod:`~wayfare.plans.models`. All features are permuted by one matching and scored in one pass over the rows.
    """
    regressor = model.stages[-1]
    paired = with_partners(df.select(*features, F.col(target).cast("double").alias("__label")), features, seed)
    errors = []
    for k, permuted in enumerate([None, *features]):
        names = [f if f != permuted else f"__other{k}" for f in features]
        if permuted is not None:
            paired = paired.withColumn(f"__other{k}", F.col(f"other.{permuted}"))
        vector, prediction = f"__vector{k}", f"__prediction{k}"
        paired = VectorAssembler(inputCols=names, outputCol=vector, handleInvalid="error").transform(paired)
        scorer = regressor.copy({regressor.getParam("featuresCol"): vector, regressor.getParam("predictionCol"): prediction})
        paired = scorer.transform(paired).drop(vector)
        off = F.col(prediction) - F.col("__label")
        errors.append(F.sqrt(F.avg(off * off)).alias(f"e{k}"))
    measured = paired.agg(*errors)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"e{k}") - F.col("e0")).alias("importance")) for k, f in enumerate(features, 1)])
    return measured.select(F.inline(rows)).orderBy(F.desc("importance"), "feature")
