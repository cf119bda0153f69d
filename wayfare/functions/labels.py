"""Human-readable labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# TLC rate codes.
RATE_CODES = {
    1: "Standard rate",
    2: "JFK",
    3: "Newark",
    4: "Nassau / Westchester",
    5: "Negotiated fare",
    6: "Group ride",
}


def label_by_code(code: Column, labels: Mapping[int, str], default: Column) -> Column:
    """Label of a small code set; codes without one get ``default``."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(known, code.cast("int")), default)


def rate_code_label(code: Column) -> Column:
    return label_by_code(code, RATE_CODES, F.concat(F.lit("Rate code "), code.cast("int")))
