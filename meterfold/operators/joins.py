"""Joins with tables that are mostly small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of up to so many rows goes to all tasks.
FEW = 20_000


def to_all_if_few(dim: DataFrame, rows: int = FEW) -> DataFrame:
    """dim, to be sent to all tasks if it has few rows, so that what it is joined to isn't dealt by its keys, of which some may be hot; a larger one is left to the planner."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim
