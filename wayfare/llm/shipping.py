"""The package's source on the Python workers; see :mod:`wayfare.shipping`."""

from wayfare.shipping import ship_package

__all__ = ["ship_package"]
