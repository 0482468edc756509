"""Point lookups, generic find and count, newest record per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.operators.paging import page
from noticemill.schemas import CANONICAL_KEY


def get_raw(raw: DataFrame, source_name: str, source_id: str) -> DataFrame:
    """The record with that key, or no row."""
    hit = (F.col("source_name") == source_name) & (F.col("source_id") == source_id)
    return raw.filter(hit).limit(1)


def find(
    df: DataFrame,
    where: Column | None = None,
    limit: int = 100,
    skip: int = 0,
    keys: Sequence[str] = CANONICAL_KEY,
) -> DataFrame:
    """Rows that match, in key order, from ``skip`` on."""
    rows = df if where is None else df.filter(where)
    return page(rows, [F.col(c) for c in keys], keys, skip, limit)


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.agg(F.count("*").alias("count"))


def latest_per_source(raw: DataFrame, tie: str = "source_id") -> DataFrame:
    """Per source the id fetched last; pre-aggregated before the shuffle."""
    newest = F.max(F.struct("fetched_at", F.col(tie).alias("_tie"), "source_id")).alias("_newest")
    return raw.groupBy("source_name").agg(newest).select("source_name", "_newest.source_id")
