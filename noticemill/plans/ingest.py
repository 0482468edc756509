"""Collect: landed pages of many sources into the raw table."""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.operators.lookup import latest_per_source
from noticemill.operators.merge import apply_actions, merge_actions
from noticemill.operators.tables import RecordTable
from noticemill.schemas import RAW_KEY
from noticemill.session import size_shuffles, written
from noticemill.sources.landing import read_pages
from noticemill.sources.resume import take_until_checkpoint
from noticemill.sources.spec import (
    ARRIVAL,
    explode_pages,
    get_source,
    pages_to_read,
    records,
    source_names,
    stamp,
    unreadable,
)

log = logging.getLogger(__name__)

CONCURRENT_SOURCES = 5
SUMMARY = "items_collected long, items_skipped long, failures int, elapsed_s double"


def incoming(
    records: DataFrame, stored: DataFrame, fetched_at: Column, resume: bool = True
) -> DataFrame:
    """Records of a run, stamped with their fetch time; with ``resume`` only those before each
    source's checkpoint, the record stored last."""
    if resume:
        records = take_until_checkpoint(records, latest_per_source(stored))
    return stamp(records, fetched_at, stored)


def collect_counts(actions: DataFrame) -> DataFrame:
    """One row: items_collected, items_skipped."""
    zero = F.lit(0).cast("long")
    return actions.agg(
        F.coalesce(F.sum("n_writes"), zero).alias("items_collected"),
        F.coalesce(F.sum("n_skips"), zero).alias("items_skipped"),
    )


def collect(
    spark: SparkSession,
    table: RecordTable,
    paths: Mapping[str, str],
    batch: int,
    as_of: date | None = None,
    fetched_at: Column | None = None,
    resume: bool = True,
    allow_missing: bool = True,
    until_empty: bool = False,
) -> DataFrame:
    """Run the sources in ``paths`` into the raw table; returns the one-row summary.

    The i-th source writes table batch ``batch + i``: keys of different sources never meet, so
    each is a job of its own and one that fails leaves the others as they are. A failed or
    unknown source counts as a failure. So does one with pages that cannot be read: its other
    pages are stored, and these go to the folder ``unreadable`` of the table with their reasons.
    """
    started = time.monotonic()
    moment = F.current_timestamp() if fetched_at is None else fetched_at
    size_shuffles(spark, table.path, *paths.values())
    table.compact_after(spark, before=batch)

    def run(number: int, name: str, path: str) -> tuple[int, int, int]:
        spec = get_source(name)
        pages = read_pages(spark, spec, path, allow_missing)
        asked = pages_to_read(pages, until_empty, spec.one_run)
        rows = written(records(spec, explode_pages(asked), as_of), "records")
        mine = table.read(
            spark, batch, ("fetched_at", "content_hash"), F.col("source_name") == name
        )
        # responses are parsed once; the steps after it read columns of tables
        arriving = written(incoming(rows, mine, moment, resume), "arriving")
        actions = written(merge_actions(arriving, mine, RAW_KEY, ARRIVAL), "actions")
        counts = collect_counts(actions).first()
        # where nothing is to be written, the payload of the run need not be shuffled to find that out
        changes = arriving.limit(0)
        if counts["items_collected"]:
            changes = apply_actions(arriving, actions, RAW_KEY, ARRIVAL)
        table.write_batch(changes, number)
        bad = unreadable(pages, name)
        n_bad = 0 if bad is None else table.write_aside(bad, "unreadable", number)
        if n_bad:
            log.error("%s: %d pages could not be read", name, n_bad)
        return counts["items_collected"], counts["items_skipped"], int(n_bad > 0)

    collected = skipped = failures = 0
    with ThreadPoolExecutor(CONCURRENT_SOURCES) as pool:
        runs = [
            pool.submit(run, batch + i, name, path) for i, (name, path) in enumerate(paths.items())
        ]
        for done in runs:
            if done.exception() is None:
                collected += done.result()[0]
                skipped += done.result()[1]
                failures += done.result()[2]
            else:
                log.error("source failed: %s", done.exception())
                failures += 1
    elapsed = round(time.monotonic() - started, 2)
    return spark.createDataFrame([(collected, skipped, failures, elapsed)], SUMMARY)


def default_paths(landing: str) -> dict[str, str]:
    """Every registered source below one landing folder."""
    return {name: f"{landing}/{name}" for name in source_names()}


def as_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct("*")).alias("summary"))
