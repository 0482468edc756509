"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """A bounded count: true when the frame has at most ``max_rows`` rows."""
    return df.select(F.lit(1).alias("one")).limit(max_rows + 1).count() <= max_rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Hint a broadcast for a side known to be small; otherwise leave the plain join, which AQE
    runs as a sort-merge join and splits where a key is skewed."""
    return F.broadcast(df) if small else df
