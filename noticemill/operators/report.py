"""Counts, timelines and listings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticemill.functions import display
from noticemill.operators.paging import DASHBOARD_PAGE, check_limit, page
from noticemill.schemas import CANONICAL_KEY, RAW_KEY

TIMELINE_DAYS = 90


def table_counts(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: raw_count, canonical_count."""
    return raw.agg(F.count("*").alias("raw_count")).select(
        "raw_count", canonical.agg(F.count("*").alias("n")).scalar().alias("canonical_count")
    )


def _filled(column: str, label: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(label))


def _counted(df: DataFrame, value: Column, name: str) -> DataFrame:
    return (
        df.groupBy(value.alias(name))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.col(name))
    )


def by_category(canonical: DataFrame) -> DataFrame:
    return _counted(canonical, _filled("category", "uncategorized"), "category")


def by_status(canonical: DataFrame) -> DataFrame:
    return _counted(canonical, _filled("status", "unknown"), "status")


def by_source(raw: DataFrame) -> DataFrame:
    return _counted(raw, F.col("source_name"), "source")


def source_list(raw: DataFrame) -> DataFrame:
    return _counted(raw, F.col("source_name"), "name")


def timeline(raw: DataFrame, days: int = TIMELINE_DAYS, latest: bool = False) -> DataFrame:
    """Records per day, oldest days first; ``latest`` keeps the newest days instead."""
    # grouped as dates, written as text once per day
    daily = raw.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("count"))
    first = daily.orderBy(F.desc("day") if latest else F.asc("day")).limit(days)
    named = first.select(display.day("day").alias("date"), "count")
    return named.orderBy("date") if latest else named


def canonical_stats(canonical: DataFrame) -> DataFrame:
    """(metric, label, count): total, categories and statuses in one pass."""
    labelled = canonical.select(
        _filled("category", "uncategorized").alias("category"),
        _filled("status", "unknown").alias("status"),
    )
    sets = [[F.col("category")], [F.col("status")], []]
    counted = labelled.groupingSets(sets, "category", "status").agg(
        F.count("*").alias("count"), F.grouping_id().alias("_level")
    )
    level = F.col("_level")
    return counted.select(
        F.when(level == 1, "category").when(level == 2, "status").otherwise("canonical_count").alias("metric"),
        F.when(level == 1, F.col("category")).when(level == 2, F.col("status")).alias("label"),
        "count",
    )


def raw_stats(raw: DataFrame, days: int = TIMELINE_DAYS) -> DataFrame:
    """(metric, label, count): total, sources and the first days in one pass."""
    keyed = raw.select("source_name", F.to_date("fetched_at").alias("day"))
    sets = [[F.col("source_name")], [F.col("day")], []]
    counted = keyed.groupingSets(sets, "source_name", "day").agg(
        F.count("*").alias("count"), F.grouping_id().alias("_level")
    )
    level = F.col("_level")
    # ranks the counted rows, one per source and day; two branches would scan the table twice
    place = F.row_number().over(Window.partitionBy("_level").orderBy("day"))
    kept = counted.withColumn("_place", place).filter((level != 2) | (F.col("_place") <= days))
    return kept.select(
        F.when(level == 1, "source").when(level == 2, "day").otherwise("raw_count").alias("metric"),
        F.when(level == 1, F.col("source_name")).when(level == 2, display.day("day")).alias("label"),
        "count",
    )


def stats(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """All counts of the overview as (metric, label, count): days in order, other labels by
    count, the largest first."""
    both = raw_stats(raw).unionByName(canonical_stats(canonical))
    day = F.col("metric") == "day"
    return both.orderBy("metric", F.when(~day, -F.col("count")), "label")


def with_share(counted: DataFrame) -> DataFrame:
    """Adds each row's share of the total as a whole percentage; input is one row per label."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    return counted.withColumn("percent", F.round(share * 100, 0))


def distinct_counts(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: number of sources, number of categories, names of the sources, largest first."""
    names = raw.groupBy("source_name").agg(F.count("*").alias("count"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "source_name")))
    per_source = names.agg(
        F.count("*").alias("n_sources"),
        F.array_join(F.transform(listed, lambda s: s["source_name"]), ", ").alias("source_names"),
    )
    categories = canonical.agg(
        F.count_distinct(_filled("category", "uncategorized")).alias("n")
    ).scalar()
    return per_source.select("n_sources", categories.alias("n_categories"), "source_names")


def page_count(df: DataFrame, size: int = DASHBOARD_PAGE) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.ceil(F.count("*") / F.lit(size)).cast("long").alias("pages"),
    )


def search(term: str, fields: Sequence[str] = ("title", "description", "agency"), regex: bool = True) -> Column:
    """Case-insensitive match of the term in any of the fields."""
    pattern = "(?iu)" + (term if regex else re.escape(term))
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.col(field).rlike(pattern), F.lit(False))
    return hit


def filtered(
    df: DataFrame,
    source: str | None = None,
    category: str | None = None,
    status: str | None = None,
    term: str | None = None,
    regex: bool = True,
) -> DataFrame:
    """All given filters together; a blank one does not filter."""
    for column, value in (("source_name", source), ("category", category), ("status", status)):
        if value:
            df = df.filter(F.col(column) == value)
    return df.filter(search(term, regex=regex)) if term else df


@dataclass
class Listing:
    total: DataFrame
    records: DataFrame


def list_raw(raw: DataFrame, source: str | None = None, limit: int = 50, skip: int = 0) -> Listing:
    """Newest fetched first, with the number of all matching rows."""
    rows = filtered(raw, source=source)
    order = [F.desc("fetched_at"), F.col("source_name"), F.col("source_id")]
    return Listing(rows.agg(F.count("*").alias("total")), page(rows, order, RAW_KEY, skip, check_limit(limit)))


def list_canonical(
    canonical: DataFrame,
    source: str | None = None,
    category: str | None = None,
    status: str | None = None,
    term: str | None = None,
    limit: int = 50,
    skip: int = 0,
    regex: bool = True,
) -> Listing:
    """Newest posted first, rows without a date last."""
    rows = filtered(canonical, source, category, status, term, regex)
    order = [F.desc("posted_date"), F.col("record_id")]
    return Listing(rows.agg(F.count("*").alias("total")), page(rows, order, CANONICAL_KEY, skip, check_limit(limit)))


def display_rows(canonical: DataFrame) -> DataFrame:
    """The listing as it is shown."""
    return canonical.select(
        "record_id",
        F.coalesce(F.nullif("title", F.lit("")), F.lit(display.DASH)).alias("title"),
        F.coalesce(F.nullif("agency", F.lit("")), F.lit(display.DASH)).alias("agency"),
        display.short_date("posted_date").alias("posted"),
        display.short_date("due_date").alias("due"),
        display.money("estimated_value").alias("value"),
        "status",
    )
