"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows up to which a lookup (a few short columns) is sent to every executor.
BROADCAST_ROWS = 500_000


def within(lookup: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``lookup`` has at most ``rows`` rows; the count stops at the bound."""
    return lookup.limit(rows + 1).count() <= rows


def bounded(lookup: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``lookup`` marked for broadcast if it has at most ``rows`` rows; otherwise as
    it is, to be joined by shuffle with AQE's skew handling. Best called on a lookup
    that is already materialised."""
    return F.broadcast(lookup) if within(lookup, rows) else lookup
