"""Hash-based sampling: a row is in or out by its key, whatever the file layout.

A retried or recomputed task picks the same rows again, which ``DataFrame.sample``
does not promise once partitions change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_digest(*keys: str) -> Column:
    if not keys:
        raise ValueError("sampling by hash needs the columns that identify a row")
    # NULL gets a text no value has, or rows with NULLs would share the digest of their other keys.
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys]))


def unit_hash(*keys: str) -> Column:
    """The key mapped evenly to [0, 1): the first 52 bits of its MD5 over 2^52."""
    head = F.conv(F.substring(key_digest(*keys), 1, 13), 16, 10).cast("bigint")
    return head / F.lit(float(2**52))


def hash_sample(df: DataFrame, fraction: float, *keys: str) -> DataFrame:
    return df.filter(unit_hash(*keys) < F.lit(fraction))


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()


_SLICES = 1 << 16


def first_by_hash(df: DataFrame, rows: int, *keys: str, below: float = 1.0) -> DataFrame:
    """``rows`` pseudo-random rows: those with the smallest key digests, all if there are fewer.

    Rows are counted by slice of the hash range up to ``below``, which all hashes of ``df`` are under. The slices up to the
    one where the running count reaches ``rows`` hold enough rows whatever the multiplicity of keys; only these rows enter
    the top-k, to which otherwise every task would send its own ``rows`` smallest.
    """
    part = F.floor(unit_hash(*keys) / F.lit(below) * _SLICES)
    counts = df.groupBy(part.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("slice")  # over the slices, at most _SLICES rows
    running = counts.select("slice", F.sum("n").over(so_far).alias("seen"))
    last = running.agg(F.min(F.when(F.col("seen") >= rows, F.col("slice")))).scalar()
    likely = df.filter(part <= F.coalesce(last, F.lit(_SLICES)))
    return likely.orderBy(key_digest(*keys), *keys).limit(rows)


def sampled_projection(
    df: DataFrame, columns: list[str], keys: list[str], fraction: float, cap: int | None = None
) -> DataFrame:
    """A plotting sample: ``fraction`` of the rows, and of these ``cap`` at most where a cap is given."""
    wanted = hash_sample(df.select(*dict.fromkeys([*keys, *columns])), fraction, *keys)
    return wanted if cap is None else first_by_hash(wanted, cap, *keys, below=fraction)


def cap_rows(df: DataFrame, cap: int, *keys: str) -> DataFrame:
    """Thin the frame to about ``cap`` rows when it holds more; otherwise keep all."""
    share = F.lit(float(cap)) / _row_count(df)
    return df.filter(unit_hash(*keys) < F.least(F.lit(1.0), share))
