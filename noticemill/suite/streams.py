"""The streaming jobs over landed files, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.operators.tables import RecordTable, raw_table
from noticemill.session import scratch_path
from noticemill.streaming.jobs import (
    LATE,
    daily_counts_stream,
    daily_table,
    ingest_stream,
    merge_keyed_stream,
    merge_stream,
    stream_metrics,
)
from noticemill.suite import merging, records
from noticemill.suite import views as v

_EVENT_TABLE = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Landed response pages streamed into a raw table."""
    landing = scratch_path(spark, "stream-landing")
    records.federal_pages(spark, sf).write.json(landing)
    table = raw_table(scratch_path(spark, "stream-raw"))
    checkpoint = scratch_path(spark, "stream-checkpoint")
    ingest_stream(spark, "sam_gov", landing, table, checkpoint).awaitTermination()
    return table.read(spark).select("source_name", "source_id", "source_url", "content_hash")


STREAM_INGEST = f"""WITH {records.FEDERAL_RECORDS}
SELECT source_name, source_id, source_url, content_hash FROM federal_records"""


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Event records streamed in two batches, early and late, into a versioned table."""
    landing = scratch_path(spark, "stream-events")
    events = v.event_records(spark, sf)
    late = (F.col("fetched_at") >= F.lit(v.SPLIT).cast("timestamp")).cast("int")
    columns = ("fetched_at", "seq", "content_hash", "record_id")
    table = RecordTable(
        scratch_path(spark, "stream-table"), _EVENT_TABLE, ("record_id",), ("record_id",)
    )
    checkpoint = scratch_path(spark, "stream-checkpoint")
    schema = events.select(*columns).schema
    for half in (0, 1):
        events.filter(late == half).select(*columns).write.mode("append").parquet(landing)
        rows = spark.readStream.schema(schema).parquet(landing)
        merge_stream(
            rows, table, ("record_id",), ("fetched_at", "seq"), checkpoint, versioned=True
        ).awaitTermination()
    return table.read(spark).select("record_id", "content_hash", "version")


def stream_collect_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream over broken responses counts; records and pages as the batch job has them."""
    landing = records._broken(spark, sf)["sam_gov"]
    table = raw_table(scratch_path(spark, "stream-raw"))
    checkpoint = scratch_path(spark, "stream-checkpoint")
    ingest_stream(spark, "sam_gov", landing, table, checkpoint, files_per_batch=2).awaitTermination()
    return stream_metrics(spark, table)


STREAM_COLLECT_METRICS = f"""WITH {records.FEDERAL_RECORDS}
SELECT (SELECT count(*) FROM federal_records WHERE seq // 25 % 5 <> 0 AND seq // 25 % 7 <> 1)
    AS items_collected,
  0::BIGINT AS items_skipped,
  (SELECT count(DISTINCT o_orderkey // 25) FROM orders
   WHERE o_orderkey // 25 % 5 = 0 OR o_orderkey // 25 % 7 = 1) AS failures"""

def stream_merge_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """The same two batches, with hash and version of every key held in the state store; the second run
    goes on from the checkpoint of the first."""
    landing, checkpoint = scratch_path(spark, "stream-events"), scratch_path(spark, "stream-checkpoint")
    events = v.event_records(spark, sf)
    late = (F.col("fetched_at") >= F.lit(v.SPLIT).cast("timestamp")).cast("int")
    columns = ("fetched_at", "seq", "content_hash", "record_id")
    table = RecordTable(scratch_path(spark, "stream-table"), _EVENT_TABLE, ("record_id",), ("record_id",))
    schema = events.select(*columns).schema
    for half in (0, 1):
        events.filter(late == half).select(*columns).write.mode("append").parquet(landing)
        rows = spark.readStream.schema(schema).parquet(landing)
        merge_keyed_stream(rows, table, ("record_id",), ("fetched_at", "seq"), checkpoint).awaitTermination()
    return table.read(spark).select("record_id", "content_hash", "version")


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events counted by day over runs whose times overlap, and a last one with rows of days that are
    closed by then; what came too late is reported as such."""
    landing, checkpoint = scratch_path(spark, "stream-days"), scratch_path(spark, "stream-checkpoint")
    events = v.event_records(spark, sf).select("fetched_at", "seq")
    early = F.col("fetched_at") < F.lit(v.SPLIT).cast("timestamp")
    held_back = early & (F.col("seq") % 5 == 0)
    shuffled = [early & ~held_back & (F.col("seq") % 2 == k) for k in (0, 1)] + [~early]
    table = daily_table(scratch_path(spark, "stream-counts"))
    # the parts that take turns come with a long delay, the last one with a short one
    for part, delay in [(part, "3650 days") for part in shuffled] + [(held_back, "1 day")]:
        events.filter(part).write.mode("append").parquet(landing)
        rows = spark.readStream.schema(events.schema).parquet(landing)
        daily_counts_stream(rows, table, checkpoint, delay=delay).awaitTermination()
    late = table.read_aside(spark, LATE).groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("count"))
    return (
        table.read(spark).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
        .select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count", "late")
    )


# a day is closed once it ended a day before the newest event of the earlier parts
STREAM_DAILY_COUNTS = f"""WITH {v.EVENT_RECORDS},
marked AS (
  SELECT date_trunc('day', fetched_at) AS day, fetched_at < TIMESTAMP '{v.SPLIT}' AND seq % 5 = 0 AS held FROM event_records
),
newest AS (
  SELECT max(fetched_at) - INTERVAL 1 DAY AS mark FROM event_records
  WHERE NOT (fetched_at < TIMESTAMP '{v.SPLIT}' AND seq % 5 = 0)
)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS count, held AND day + INTERVAL 1 DAY <= mark AS late
FROM marked, newest GROUP BY ALL"""

QUERIES = {
    "stream_collect_metrics": (stream_collect_metrics, STREAM_COLLECT_METRICS),
    "stream_ingest": (stream_ingest, STREAM_INGEST),
    "stream_daily_counts": (stream_daily_counts, STREAM_DAILY_COUNTS),
    "stream_merge_keyed": (stream_merge_keyed, merging.CANONICAL_MERGE_VERSION),
    "stream_merge": (stream_merge, merging.CANONICAL_MERGE_VERSION),
}
