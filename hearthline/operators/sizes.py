"""Size checks in front of broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Narrow rows, such as (id, word): some tens of megabytes at most.
BROADCAST_ROWS = 500_000


def fits(rows: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether there are at most ``limit`` rows, without reading many more."""
    return rows.limit(limit + 1).count() <= limit


def small_side(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it fits; else as it is, for a shuffled join.

    For sides that are computed: their size cannot be read off a stored table, and
    once both sides are being shuffled it is too late to find out.
    """
    return F.broadcast(rows) if fits(rows, limit) else rows
