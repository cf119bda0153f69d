"""A monthly table that follows a folder of monthly files: each run loads what is new and nothing twice.

The target holds ``data``, partitioned by month, and ``manifest``, to which each run appends a row for every file that it loaded or missed, with
the file's size and time. A run lists the folder, finds the files that the manifest's last word on their path does not match, rebuilds their
months from all their files by a dynamic partition overwrite, and only then appends to the manifest.

A run that fails before its overwrite commits leaves data and manifest as they were: tasks write to a staging folder. A run that fails between the two
commits leaves new months without a manifest entry; the next run rebuilds the same months, so nothing is loaded twice. Other months are never
touched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.sources.monthly import MONTH_NAME, folder_files, load_files

_MANIFEST = "path string, month date, bytes long, modified long, batch long"
MONTH = "file_month"


class Synced(NamedTuple):
    """What a run did: the months rebuilt, and how many files were new or changed, and gone."""

    months: list[str]
    loaded: int
    gone: int


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(path, month, bytes, modified, batch): all entries; NULL bytes mean that the file was gone. Empty before the first run."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def current_files(entries: DataFrame) -> DataFrame:
    """(path, month, bytes, modified): the manifest's last word on each path that is not gone."""
    last = entries.groupBy("path").agg(F.max_by(F.struct("month", "bytes", "modified"), "batch").alias("last"))
    return last.select("path", "last.*").filter("bytes IS NOT NULL")


def write_months(df: DataFrame, path: str) -> None:
    """Replace the months of ``df`` and leave all others."""
    writer = df.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH).parquet(path)


def sync_months(
    spark: SparkSession, folder: str, target: str, schema: T.StructType | None = None, money: list[str] = (), name: str = MONTH_NAME
) -> Synced:
    """Bring ``target`` up to the files of ``folder``; see the module. Files whose path carries no month are left out.

    The changed files and those of their months, one row each, come to the driver.
    """
    listed = folder_files(spark, folder, name).filter("month IS NOT NULL")
    entries = manifest(spark, target)
    known = current_files(entries)
    same = ["path", "bytes", "modified"]
    changed = listed.join(known, same, "left_anti").select("path", "month", "bytes", "modified")
    vanished = known.join(listed, "path", "left_anti").select("path", "month", F.lit(None).cast("long").alias("bytes"), "modified")
    found = [r for r in changed.union(vanished).orderBy("path").collect()]
    if not found:
        return Synced([], 0, 0)
    months = sorted({r["month"] for r in found})
    files = [r["path"] for r in listed.filter(F.col("month").isin(months)).select("path").orderBy("path").collect()]
    if files:
        parts = load_files(spark, files, schema, money, of=name)
        write_months(parts, f"{target}/data")
    batch = (entries.agg(F.max("batch")).first()[0] or 0) + 1
    rows = [(r["path"], r["month"], r["bytes"], r["modified"], batch) for r in found]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return Synced([f"{m:%Y-%m}" for m in months], sum(r["bytes"] is not None for r in found), sum(r["bytes"] is None for r in found))


def synced(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all months that still have files, with ``file_month``; other partitions are not read."""
    months = current_files(manifest(spark, target)).select(F.date_format("month", "yyyy-MM").alias(MONTH)).distinct()
    data = spark.read.option("recursiveFileLookup", "false").parquet(f"{target}/data")
    return data.withColumn(MONTH, F.col(MONTH).cast("string")).join(months, MONTH, "left_semi")
