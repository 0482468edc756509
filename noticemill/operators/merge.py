"""Keyed, versioned merge of a batch into a table of one row per key.

A batch is applied as if its rows came one by one in ``order``: a row whose content hash equals
the one before it (or the stored one, for the first) is skipped, any other row is a write and
raises the version by one.

Comparing a row with the one before it needs the rows of a key in order. One key may hold a large
part of a batch, so the batch is range-partitioned by (key, order): a hot key is cut into several
ranges, each is compared within itself, and the ranges are then joined up by their first and last
hash. Only key, order and hash move in that step; the payload is fetched once, for the rows that
are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _place(order: Sequence[str], hash_col: str) -> Column:
    """A row's place among those of its key. Rows that tie in the order count as applied in the
    order of their hashes, so that a batch means the same however its rows are dealt."""
    return F.struct(*order, F.col(hash_col).alias("_tie"))


def _ranges(batch: DataFrame, keys: Sequence[str], order: Sequence[str], hash_col: str) -> DataFrame:
    """One row per key and range: rows, changes inside, ends, place of the last change."""
    narrow = batch.select(*keys, _place(order, hash_col).alias("_seq"), F.col(hash_col).alias("_hash"))
    placed = narrow.repartitionByRange(*keys, "_seq").withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_part").orderBy("_seq")
    before = F.lag(F.struct("_hash")).over(inside)
    compared = placed.withColumn(
        "_inner", before.isNotNull() & ~before["_hash"].eqNullSafe(F.col("_hash"))
    )
    return compared.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"),
        F.count_if("_inner").alias("_inner"),
        F.min(F.struct("_seq", "_hash")).alias("_first"),
        F.max(F.struct("_seq", "_hash")).alias("_last"),
        F.max(F.when(F.col("_inner"), F.col("_seq"))).alias("_changed_at"),
    )


def _single(batch: DataFrame, keys: Sequence[str], order: Sequence[str], hash_col: str) -> DataFrame:
    """The same for a batch with one row per key."""
    end = F.struct(_place(order, hash_col).alias("_seq"), F.col(hash_col).alias("_hash"))
    return batch.select(
        *keys,
        F.lit(0).alias("_part"),
        F.lit(1).cast("long").alias("_rows"),
        F.lit(0).cast("long").alias("_inner"),
        end.alias("_first"),
        end.alias("_last"),
    ).withColumn("_changed_at", F.when(F.lit(False), F.col("_first._seq")))


def merge_actions(
    batch: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hash_col: str = "content_hash",
    force: bool = False,
    one_row_per_key: bool = False,
) -> DataFrame:
    """Per key of the batch: rows, writes, skips, action, new version, place of the last write.

    ``stored`` is the current table with the keys, the hash and optionally ``version`` and
    ``created_at``. ``force`` writes every row, changed or not. ``one_row_per_key`` says that the
    batch has no repeated key, which saves putting its rows in order.
    """
    ranges = (_single if one_row_per_key else _ranges)(batch, keys, order, hash_col)
    kept = [c for c in ("version", "created_at") if c in stored.columns]
    current = stored.select(
        *keys,
        F.struct(F.col(hash_col).alias("_hash"), *kept).alias("_old"),
    )
    # one row per key and range: at most as many rows per key as there are ranges
    joined = ranges.join(current, list(keys), "left")
    in_key = Window.partitionBy(*keys).orderBy("_part")
    before = F.lag(F.struct(F.col("_last._hash").alias("_hash"))).over(in_key)
    old_hash = F.when(F.col("_old").isNotNull(), F.struct(F.col("_old._hash").alias("_hash")))
    previous = F.coalesce(before, old_hash)
    opens = previous.isNull() | ~previous["_hash"].eqNullSafe(F.col("_first._hash"))
    linked = joined.withColumn("_opens", opens)
    if force:
        writes, written_at = F.col("_rows"), F.col("_last._seq")
    else:
        writes = F.col("_inner") + F.col("_opens").cast("long")
        written_at = F.coalesce("_changed_at", F.when(F.col("_opens"), F.col("_first._seq")))
    per_key = linked.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"),
        F.sum(writes).alias("n_writes"),
        F.max(written_at).alias("_written_at"),
        F.first("_old").alias("_old"),
    )
    action = (
        F.when(F.col("n_writes") == 0, "skip")
        .when(F.col("_old").isNull(), "insert")
        .otherwise("update")
    )
    old_version = F.col("_old.version") if "version" in kept else F.lit(0)
    return per_key.select(
        *keys,
        "n_rows",
        "n_writes",
        (F.col("n_rows") - F.col("n_writes")).alias("n_skips"),
        action.alias("action"),
        (F.coalesce(old_version, F.lit(0)) + F.col("n_writes")).cast("int").alias("new_version"),
        "_written_at",
        *([F.col("_old.created_at").alias("_old_created_at")] if "created_at" in kept else []),
    )


def apply_actions(
    batch: DataFrame,
    actions: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    versioned: bool = False,
    now: Column | None = None,
    hash_col: str = "content_hash",
) -> DataFrame:
    """The rows of the batch that ``actions`` (from ``merge_actions``) write: per changed key its
    last written row. Of rows that are at one place with one content, one stays.

    With ``versioned`` the row gets its new version, ``updated_at`` = now, and the
    ``created_at`` of the first version.
    """
    written = actions.filter(F.col("n_writes") > 0).select(
        *keys,
        "_written_at",
        "new_version",
        *[c for c in actions.columns if c == "_old_created_at"],
    )
    on = [*keys, "_written_at"]
    rows = batch.withColumn("_written_at", _place(order, hash_col)).join(written, on)
    rows = rows.dropDuplicates(on)
    if versioned:
        now = F.current_timestamp() if now is None else now
        first = F.col("_old_created_at") if "_old_created_at" in written.columns else F.lit(None)
        created = F.coalesce(first, F.col("created_at") if "created_at" in batch.columns else now)
        rows = rows.withColumns(
            {
                "version": F.col("new_version"),
                "created_at": created.cast("timestamp"),
                "updated_at": now.cast("timestamp"),
            }
        )
    return rows.drop("_written_at", "new_version", "_old_created_at")


def merge_changes(
    batch: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hash_col: str = "content_hash",
    versioned: bool = False,
    now: Column | None = None,
    force: bool = False,
    one_row_per_key: bool = False,
) -> DataFrame:
    """The rows a batch writes: ``merge_actions`` applied to the batch."""
    actions = merge_actions(batch, stored, keys, order, hash_col, force, one_row_per_key)
    return apply_actions(batch, actions, keys, order, versioned, now, hash_col)


def snapshot(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the merge: rows whose key did not change, and the changes, which are read
    twice and best given as a table."""
    kept = stored.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.select(*stored.columns))


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
