"""boutline: analytics of paired competitions as Spark DataFrame operators."""

from boutline.roles import MATCH, Roles

__all__ = ["MATCH", "Roles"]
