"""Bring chosen documents' texts to where they are needed, without shuffling the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 1 << 18  # 64-bit words of the key bitmap: 16.8 million bits


def _bit(key: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(key), F.lit(64 * _WORDS))
    return F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")


def _bitmap(keyed: DataFrame, key: Column) -> DataFrame:
    """(__word, __bits) of the keys' hashes: at most ``_WORDS`` rows, whatever the table holds."""
    word, bit = _bit(key)
    bits = F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")
    return keyed.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(bits)


def _marked(rows: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``__likely``, whether the bitmap has the key's bit."""
    word, bit = _bit(key)
    placed = rows.withColumns({"__own_word": word, "__own_bit": bit})
    met = placed.join(F.broadcast(bitmap), F.col("__own_word") == F.col("__word"), "left")
    likely = F.coalesce(F.expr("shiftright(__bits, __own_bit) & 1") == 1, F.lit(False))
    return met.select(*rows.columns, likely.alias("__likely"))


def split_rows(rows: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without a key of ``keys``, rows with one), NULL matching NULL, on the columns ``names`` of both.

    ``keys`` is unique on them. Only rows that the bitmap of keys marks are shuffled.
    """
    marked = _marked(rows, F.xxhash64(*names), _bitmap(keys, F.xxhash64(*names)))
    likely = marked.filter("__likely").drop("__likely").alias("r")
    same = [F.col(f"r.`{n}`").eqNullSafe(F.col(f"k.`{n}`")) for n in names]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    chosen = keys.select(*names).alias("k")
    rest = marked.filter("NOT __likely").drop("__likely")
    return rest.unionByName(likely.join(chosen, condition, "left_anti")), likely.join(chosen, condition, "left_semi")


def texts_for(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` joined to ``wanted`` on its column ``of``, NULL matching NULL.

    A bitmap of the wanted keys' hashes, at most ``_WORDS`` rows whatever the tables hold and so broadcast, first
    drops most documents that are not wanted; the join that follows is exact. With far more keys than bits it
    drops little and the join does all the work.
    """
    marked = _marked(texts, F.col("doc_id"), _bitmap(wanted, F.col("of")))
    likely = marked.filter("__likely").drop("__likely")
    return likely.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")))
