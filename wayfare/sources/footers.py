"""Statistics of Parquet files from their footers, read in tasks: no data page is touched, no footer comes to the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.shipping import ship_package

_SCHEMA = pa.schema(
    [
        ("path", pa.string()), ("month", pa.date32()), ("bytes", pa.int64()), ("rows", pa.int64()), ("n_columns", pa.int32()),
        ("first", pa.timestamp("us")), ("last", pa.timestamp("us")), ("vintage", pa.string()), ("unread", pa.string()),
    ]
)
_DDL = "path string, month date, bytes long, rows long, n_columns int, first timestamp_ntz, last timestamp_ntz, vintage string, unread string"
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _opened(path: str) -> pq.ParquetFile:
    """The file at a path as Spark lists it."""
    if re.match(r"^(file:)?/", path):
        return pq.ParquetFile(re.sub(r"^file:/*", "/", path))
    files, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return pq.ParquetFile(files.open_input_file(inner))


def _extent(meta: pq.FileMetaData, start: str) -> tuple[pa.Scalar | None, pa.Scalar | None]:
    """The smallest and largest value of a time column by its row groups' statistics; (None, None) if any group lacks them."""
    low = high = None
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema.lower() != start.lower():
                continue
            stats = column.statistics
            if stats is not None and stats.null_count == group.num_rows:
                continue
            if stats is None or not stats.has_min_max:
                return None, None
            low = stats.min if low is None else min(low, stats.min)
            high = stats.max if high is None else max(high, stats.max)
    return low, high


def _plain(value) -> object:
    return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) is not None else value


def footers(files: DataFrame, start: str) -> DataFrame:
    """(path, month, bytes, rows, n_columns, first, last, vintage, unread) of ``files(path, month, bytes)``.

    ``first`` and ``last`` are the extent of the column ``start`` by the statistics in the footer, NULL where those are missing.
    ``vintage`` is equal for files with the same stored schema. A file that a task cannot open, because its storage needs Spark's
    own readers or it is no Parquet file, says why in ``unread`` and has NULLs.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, month, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    meta = _opened(path).metadata
                except (OSError, pa.ArrowException) as reason:
                    rows.append((path, month, size, *[None] * 5, str(reason)[:500]))
                    continue
                low, high = map(_plain, _extent(meta, start))
                stored = (meta.metadata or {}).get(_SPARK_SCHEMA, b"").decode()
                vintage = f"{meta.schema.to_arrow_schema().remove_metadata()}\n{stored}"
                rows.append((path, month, size, meta.num_rows, meta.num_columns, low, high, vintage, None))
            columns = list(zip(*rows)) or [()] * len(_SCHEMA)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    ship_package(files.sparkSession)
    return files.select("path", "month", "bytes").mapInArrow(read, _DDL)


def footer_stats(found: DataFrame) -> DataFrame:
    """One row over :func:`footers`: files, bytes, records, most columns, first and last date, months named, files without a month, schema vintages, unread files."""
    return found.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_records"),
        F.max("n_columns").alias("n_columns"),
        F.to_date(F.min("first")).alias("first_date"),
        F.to_date(F.max("last")).alias("last_date"),
        F.count_distinct("month").alias("n_months"),
        F.count_if(F.col("month").isNull()).alias("n_unmatched"),
        F.count_distinct("vintage").alias("n_vintages"),
        F.count_if(F.col("unread").isNotNull()).alias("n_unread"),
    )


def folder_coverage(found: DataFrame) -> DataFrame:
    """(period, files, bytes, rows) of the months that files are named for, from :func:`footers`; fit for ``period_gaps`` and ``coverage_summary``."""
    named = found.filter("month IS NOT NULL").groupBy(F.col("month").alias("period"))
    return named.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
