"""Read landed pages of one or many sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.session import path_exists
from noticemill.sources.spec import (
    LANDED,
    SourceSpec,
    check_packed,
    check_runs,
    explode_pages,
    pages_to_read,
    records,
)


def empty_pages(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("page_offset", T.LongType()),
            T.StructField("total_records", T.LongType()),
            T.StructField("rows", T.ArrayType(spec.row_type)),
            T.StructField(
                LANDED,
                T.StructType(
                    [
                        T.StructField("file_modification_time", T.TimestampType()),
                        T.StructField("file_path", T.StringType()),
                    ]
                ),
            ),
        ]
    )
    return spark.createDataFrame([], schema)


def read_source(
    spark: SparkSession,
    spec: SourceSpec,
    path: str,
    as_of: date | None = None,
    allow_missing: bool = False,
    until_empty: bool = False,
) -> DataFrame:
    """Raw records of one source, each with its ``seq``."""
    pages = read_pages(spark, spec, path, allow_missing)
    return records(spec, explode_pages(pages_to_read(pages, until_empty, spec.one_run)), as_of)


def read_pages(
    spark: SparkSession, spec: SourceSpec, path: str, allow_missing: bool = False
) -> DataFrame:
    """The landed pages of one source, those with a problem included."""
    if allow_missing and not path_exists(spark, path):
        return empty_pages(spark, spec)
    pages = spec.read_pages(spark, path)
    if spec.one_run:
        files = pages.inputFiles()
        check_runs(files)
        check_packed(pages, files)
    return pages


def page_snapshots(pages: DataFrame, source_name: str, label: str = "page") -> DataFrame:
    """Pages kept as raw text, with the file name a snapshot of each would get."""
    segment = F.substring(F.element_at(F.split("url", "/"), -1), 1, 60)
    return pages.select(
        F.col("page_id").cast("string").alias("source_id"),
        F.lit(source_name).alias("source_name"),
        F.col("url").alias("source_url"),
        F.col("html").alias("raw_html"),
        F.concat(F.lit(f"{label}_"), segment, F.lit(".html")).alias("snapshot_name"),
    )
