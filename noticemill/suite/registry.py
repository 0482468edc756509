"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticemill.suite import merging, records, reports, streams, texts

ALL = {**records.QUERIES, **merging.QUERIES, **reports.QUERIES, **texts.QUERIES, **streams.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
