"""wayfare: trip, order and event analytics expressed as Spark DataFrame plans.

Every operator takes a DataFrame plus a :class:`~wayfare.roles.Roles` mapping
(which column plays which part) and returns a *lazy* DataFrame.
"""

from wayfare.roles import TLC, Limits, Roles

__all__ = ["TLC", "Limits", "Roles"]
