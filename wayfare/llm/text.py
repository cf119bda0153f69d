"""Column expressions on whole texts, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, though a lambda inside may use it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)
