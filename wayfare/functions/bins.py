"""Histogram bin expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped_bin(value: Column, width: int, cap: int) -> Column:
    """Lower edge of the ``width``-wide bin; everything from ``cap`` up shares one bin."""
    edge = (F.floor(value / width) * width).cast("int")
    return F.when(value >= cap, F.lit(cap)).otherwise(edge)


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL: ``least``/``greatest`` would silently replace it by a bound."""
    bounded = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """1-based bin of a value clipped to ``[low, high]``; the last bin is closed."""
    step = (high - low) / bins
    position = F.floor((clip(value, low, high) - F.lit(float(low))) / F.lit(step)) + 1
    return F.when(value.isNotNull(), F.least(position, F.lit(bins))).cast("int")
