"""Prefix sums over ranges of sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticemill.session import written


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], name: str
) -> DataFrame:
    """The frame with, for each value, its sum over the rows before this one in its group.

    Rows are dealt by ranges of (group, order), so one group may span any number of tasks: each
    range is summed by itself, and the sums of the ranges before it are added. Groups must not be
    null. Rows that tie in the order are told apart arbitrarily, so the order should hold all that
    the values depend on.
    """
    for key, value in values.items():
        df = df.withColumn(f"_value_{key}", value)
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    placed = written(ranged.withColumn("_range", F.spark_partition_id()), name)
    sums = placed.groupBy(*group, "_range").agg(
        *[F.sum(f"_value_{key}").alias(f"_sum_{key}") for key in values]
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{key}").over(earlier), F.lit(0)).alias(f"_base_{key}") for key in values],
    )
    inside = (
        Window.partitionBy(*group, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = [c for c in df.columns if not c.startswith("_value_")]
    summed = placed.select(
        *kept,
        "_range",
        *[F.coalesce(F.sum(f"_value_{key}").over(inside), F.lit(0)).alias(f"_inside_{key}") for key in values],
    )
    joined = summed.join(before, [*group, "_range"])
    return joined.select(
        *kept, *[(F.col(f"_inside_{key}") + F.col(f"_base_{key}")).alias(key) for key in values]
    )
