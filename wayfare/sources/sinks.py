"""Writers and the shared folder they use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset; one parent folder per application.

    Both must be storage that the driver and all executors reach, so a cluster whose checkpoint folder is unset and whose warehouse is a local
    path is refused: its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and base.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/wayfare-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite ``path`` as Parquet, one folder per combination of ``by`` values.

    The rebalance hint gathers a partition value's rows so tasks do not each open a file
    per value, while adaptive execution still splits a value too big for one task.
    """
    df.hint("rebalance", *map(F.col, by)).write.mode("overwrite").partitionBy(*by).parquet(path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a pre-aggregated result to the shared folder and read it back.

    Spark then knows its true size when it plans a join (an aggregate of a huge table is
    otherwise taken for huge, and the facts are shuffled to meet a few megabytes), and
    nothing that uses it recomputes it, also after an executor is lost.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
