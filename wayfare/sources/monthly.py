"""Loading a set of monthly files whose schemas drifted."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions.timeparts import month_start
from wayfare.operators.aggregates import row_count
from wayfare.sources.footers import footers
from wayfare.sources.schemas import cast_present, conform, union_by_name

# Paths that the driver lists at a time.
_LISTED_AT_ONCE = 16
# Where a file's name carries its month.
MONTH_NAME = r"(\d{4}-\d{2})\.parquet$"


class Loaded(NamedTuple):
    df: DataFrame | None
    present: list[str]
    missing: list[str]
    unmatched: list[str] = []


def _stored_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files at or directly under ``path``; none if it does not exist."""
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return sorted(r["path"] for r in listed.select("path").collect())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _vintages(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """The files by stored schema, from footers read in tasks; a file that tasks cannot open is a vintage of its own."""
    rows = spark.createDataFrame([(f,) for f in files], "path string")
    listed = rows.select("path", F.lit(None).cast("date").alias("month"), F.lit(0).cast("long").alias("bytes"))
    held: dict[str, list[str]] = defaultdict(list)
    for r in footers(listed, "").select("path", F.coalesce(F.sha2("vintage", 256), "path").alias("of")).orderBy("path").collect():
        held[r["of"]].append(r["path"])
    return list(held.values())


def load_files(
    spark: SparkSession, files: list[str], schema: T.StructType | None = None, money: list[str] = (), of: str | None = None
) -> DataFrame | None:
    """The union of the files: one scan for each stored schema, whose columns Spark takes from one of its files.

    With ``of``, a pattern as for :func:`folder_files`, each row also has ``file_month``, that of its file, as "YYYY-MM".
    """
    if not files:
        return None
    wanted = T.StructType([*schema, T.StructField("file_month", T.StringType())]) if schema and of else schema
    parts = []
    for own in _vintages(spark, sorted(files)):
        part = spark.read.schema(spark.read.parquet(own[0]).schema).parquet(*own)
        if of is not None:
            part = part.withColumn("file_month", F.regexp_extract("_metadata.file_path", of, 1))
        parts.append(conform(part, wanted) if schema else cast_present(part, list(money)))
    return union_by_name(parts)


def load_months(
    spark: SparkSession,
    paths: Mapping[str, str | Sequence[str]],
    schema: T.StructType | None = None,
    money: list[str] = (),
) -> Loaded:
    """Union the months that exist; absent ones are reported, not fatal.

    ``paths`` maps a month to its file or folder, or to several. Only listings and footers are read here. Files that
    share a stored schema become one scan, so the plan grows with the number of schema
    vintages rather than with the number of files, and no file is read with another's schema. With ``schema`` every
    vintage is conformed to it; without, ``money`` columns become double and columns merge by name.
    """
    months = sorted(paths)
    given = [(m, path) for m in months for path in ([paths[m]] if isinstance(paths[m], str) else paths[m])]
    with ThreadPoolExecutor(_LISTED_AT_ONCE) as pool:
        listed = list(pool.map(lambda x: _stored_files(spark, x[1]), given))
    found = {m for (m, _), files in zip(given, listed) if files}
    df = load_files(spark, [file for files in listed for file in files], schema, money)
    return Loaded(df, [m for m in months if m in found], [m for m in months if m not in found])


def folder_files(spark: SparkSession, folder: str, name: str = MONTH_NAME) -> DataFrame:
    """(month, path, bytes, modified) of every Parquet file of a folder, ``modified`` in microseconds; the month is NULL where the path carries none."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    found = F.nullif(F.regexp_extract("path", name, 1), F.lit(""))
    return listed.select(
        F.to_date(F.concat(found, F.lit("-01"))).alias("month"), "path", F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("modified")
    )


def monthly_files(spark: SparkSession, folder: str, name: str = MONTH_NAME) -> DataFrame:
    """(month, path, bytes, modified) of the files whose name carries their month; nothing is read."""
    return folder_files(spark, folder, name).filter("month IS NOT NULL")


def month_range(first: str, last: str) -> list[str]:
    """Every month from ``first`` to ``last``, both "YYYY-MM" and inclusive."""
    if first > last:
        raise ValueError(f"{first} is after {last}")
    (y1, m1), (y2, m2) = (map(int, month.split("-")) for month in (first, last))
    return [f"{n // 12}-{n % 12 + 1:02d}" for n in range(y1 * 12 + m1 - 1, y2 * 12 + m2)]


def load_folder(
    spark: SparkSession,
    folder: str,
    months: list[str] | None = None,
    schema: T.StructType | None = None,
    money: list[str] = (),
    name: str = MONTH_NAME,
) -> Loaded:
    """:func:`load_months` over a folder of monthly files; all of them by default.

    A month may have several files. Files whose path carries no month are not loaded but returned as ``unmatched``. The folder is listed
    once and only the listing, one row per file, comes to the driver; footers are read in tasks.
    """
    found: dict[str, list[str]] = defaultdict(list)
    unmatched = []
    for r in folder_files(spark, folder, name).orderBy("path").collect():
        if r["month"] is None:
            unmatched.append(r["path"])
        else:
            found[f"{r['month']:%Y-%m}"].append(r["path"])
    wanted = sorted(set(months)) if months is not None else sorted(found)
    present = [m for m in wanted if m in found]
    df = load_files(spark, [file for m in present for file in found[m]], schema, money)
    return Loaded(df, present, [m for m in wanted if m not in found], unmatched)


def load_stats(df: DataFrame, start: str) -> DataFrame:
    """One row: records, columns, first and last date, months present."""
    return (
        df.groupBy(month_start(start).alias("month"))
        .agg(row_count().alias("rows"), F.min(start).alias("lo"), F.max(start).alias("hi"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("n_records"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.to_date(F.min("lo")).alias("first_date"),
            F.to_date(F.max("hi")).alias("last_date"),
            F.count("month").alias("n_months"),
        )
    )


def file_stats(df: DataFrame) -> DataFrame:
    """One row: files, bytes and rows behind a file-based frame.

    Only file metadata is touched: no data column is read.
    """
    per_file = df.groupBy(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(row_count().alias("rows"))
    return per_file.agg(
        row_count().alias("n_files"), F.sum("bytes").alias("size_bytes"), F.sum("rows").alias("n_records")
    )
