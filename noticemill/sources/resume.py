"""Stop a source at the last record an earlier run stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.operators.joins import broadcast_if, is_small
from noticemill.session import written


def newest_first(moment: Column, *ties: str) -> Column:
    """An order for rows of a source that lists its newest first."""
    return F.struct(-F.unix_micros(moment.cast("timestamp")), *ties)


def take_until_checkpoint(
    records: DataFrame, checkpoints: DataFrame, order: Column | str = "seq"
) -> DataFrame:
    """Per source and listing, the records before the one whose id is the checkpoint.

    A folder may hold the listings of several runs, told apart by the column ``landing`` where the
    records have it; each is cut by itself, as an old listing says nothing about a newer one.

    ``order`` is the place of a record in its source, by default its sequence number.
    ``checkpoints`` has one row (source_name, source_id) per source; a source without one, or
    whose checkpoint does not occur, keeps all records. The cut is an aggregate, so no source is
    ever sorted or gathered in one place. There is at most one cut per checkpoint and listing.
    """
    marks = checkpoints.select("source_name", F.col("source_id").alias("mark_id"))
    small = is_small(marks)
    listing = F.col("landing") if "landing" in records.columns else F.lit("")
    placed = records.withColumns(
        {"_place": F.col(order) if isinstance(order, str) else order, "_listing": listing}
    )
    cuts = (
        placed.select("source_name", "source_id", "_place", "_listing")
        .join(broadcast_if(small, marks), "source_name")
        .filter(F.col("source_id") == F.col("mark_id"))
        .groupBy("source_name", "_listing")
        .agg(F.min("_place").alias("_cut"))
    )
    cuts = written(cuts, "cuts")
    return (
        placed.join(broadcast_if(is_small(cuts), cuts), ["source_name", "_listing"], "left")
        .filter(F.col("_cut").isNull() | (F.col("_place") < F.col("_cut")))
        .drop("_cut", "_place", "_listing")
    )
