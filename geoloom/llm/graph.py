"""Joins against lists of identifiers; components of links and joins without a crowded key come from the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.links import components, spread_join, union_find

__all__ = ["BROADCAST_IDS", "components", "rows_with", "spread_join", "union_find"]

#: A list of identifiers is broadcast up to this many rows (8 bytes each), joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000


def rows_with(df: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_semi``) or isn't (``left_anti``) among the distinct ``ids``."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)
