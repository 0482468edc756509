"""Pages of a sorted listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticemill.operators.joins import broadcast_if
from noticemill.session import shared_dir

MAX_LIMIT = 500
DASHBOARD_PAGE = 25
TOP_ROWS = 10_000


def page(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str],
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    """Rows skip+1 … skip+limit in ``order``; ``keys`` identify a row.

    Near the top each task keeps its best skip+limit rows. Further down the rows are ranked
    where they lie, in range partitions, and only the wanted ones leave their task.
    """
    if skip < 0 or limit < 1:
        raise ValueError("skip must be at least 0 and limit at least 1")
    if skip + limit <= TOP_ROWS:
        return df.orderBy(*order).offset(skip).limit(limit)
    return deep_page(df, order, keys, skip, limit)


def deep_page(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str], skip: int, limit: int
) -> DataFrame:
    """The same page by distributed ranks; the driver and each task hold no long prefix.

    Only sort columns and keys are ranked. They are checkpointed because the ranges are used
    twice, for the sizes and for the ranks, and must be the same both times.
    """
    shared_dir(df.sparkSession)
    ranked_by = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranked_by.select(
        *keys,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_place"),
    ).checkpoint()
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition, so this window and the broadcast are bounded by their number
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    starts = sizes.withColumn("_before", before).filter(
        (F.col("_before") < skip + limit) & (F.col("_before") + F.col("_size") > skip)
    )
    in_part = F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    rank = F.col("_before") + in_part + 1
    wanted = (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("_rank", rank)
        .filter((F.col("_rank") > skip) & (F.col("_rank") <= skip + limit))
        .select(*keys, "_rank")
    )
    rows = df.join(broadcast_if(limit <= TOP_ROWS, wanted), list(keys))
    return rows.orderBy("_rank").limit(limit).select(*df.columns)


def next_page(
    df: DataFrame,
    column: str,
    key: str,
    last_value: object,
    last_key: object,
    limit: int = DASHBOARD_PAGE,
) -> DataFrame:
    """The page after a known row when sorted by ``column`` descending (nulls last) and key.

    A filter replaces the offset, so every page costs the same.
    """
    value, ident = F.col(column), F.col(key)
    if last_value is None:
        after = value.isNull() & (ident > last_key)
    else:
        after = (
            (value < last_value) | ((value == last_value) & (ident > last_key)) | value.isNull()
        )
    return df.filter(after).orderBy(value.desc(), ident).limit(limit)


def dashboard_page(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str], number: int
) -> DataFrame:
    """Page ``number`` (from 0) of 25 rows."""
    return page(df, order, keys, number * DASHBOARD_PAGE, DASHBOARD_PAGE)


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit
