"""Every operator as a runnable query over the test tables, with its SQL twin."""

from wayfare.catalog import analyses, cleaning, features, modelling, quality, sources  # noqa: F401
from wayfare.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
