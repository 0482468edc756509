"""Keyed merges, lookups and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.operators.lookup import count, find, get_raw, latest_per_source
from noticemill.operators.merge import key_violations, merge_actions, merge_changes, snapshot
from noticemill.operators.tables import RecordTable
from noticemill.plans.curate import only_new
from noticemill.schemas import CANONICAL_KEY, RAW_KEY
from noticemill.session import scratch_path, written
from noticemill.sources.resume import take_until_checkpoint
from noticemill.suite import views as v

_ORDER = ("fetched_at", "seq")
_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_SQL_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def raw_merge_actions(spark: SparkSession, sf: str) -> DataFrame:
    actions = merge_actions(
        v.arriving_events(spark, sf), v.stored_events(spark, sf).drop("version"), RAW_KEY, _ORDER
    )
    return actions.select(*RAW_KEY, "n_rows", "n_writes", "n_skips", "action")


RAW_MERGE_ACTIONS = f"""WITH {v.EVENT_WRITES},
per_key AS (
  SELECT source_name, source_id, count(*) AS n_rows, count(*) FILTER (is_write) AS n_writes
  FROM event_writes WHERE NOT early GROUP BY ALL
)
SELECT source_name, source_id, n_rows, n_writes, n_rows - n_writes AS n_skips,
  CASE WHEN n_writes = 0 THEN 'skip'
    WHEN EXISTS (SELECT 1 FROM event_writes e WHERE e.early AND e.source_name = p.source_name
      AND e.source_id = p.source_id) THEN 'update' ELSE 'insert' END AS action
FROM per_key p"""


def raw_merge(spark: SparkSession, sf: str) -> DataFrame:
    stored = v.stored_events(spark, sf).select(*RAW_KEY, "fetched_at", "seq", "content_hash")
    changes = merge_changes(v.arriving_events(spark, sf), stored, RAW_KEY, _ORDER)
    merged = snapshot(stored, written(changes, "changes"), RAW_KEY)
    return merged.withColumn("fetched_at", F.date_format("fetched_at", _STAMP))


RAW_MERGE = f"""WITH {v.EVENT_WRITES}
SELECT source_name, source_id, strftime(max(fetched_at), {_SQL_STAMP}) AS fetched_at,
  arg_max(seq, (fetched_at, seq)) AS seq, arg_max(content_hash, (fetched_at, seq)) AS content_hash
FROM event_writes WHERE is_write GROUP BY source_name, source_id"""


_EVENT_TABLE = T.StructType(
    [
        T.StructField("source_name", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def table_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The merge as batches of a record table, with a compaction in between."""
    place = scratch_path(spark, "events")
    table = RecordTable(place, _EVENT_TABLE, RAW_KEY, ("source_name", "fetched_at"))
    early = v.event_records(spark, sf).filter(F.col("fetched_at") < F.lit(v.SPLIT).cast("timestamp"))
    for number, batch in enumerate((early, v.arriving_events(spark, sf))):
        table.write_batch(merge_changes(batch, table.read(spark), RAW_KEY, _ORDER), number)
        if number == 0:
            table.compact(spark)
    merged = table.read(spark)
    return merged.withColumn("fetched_at", F.date_format("fetched_at", _STAMP))


def canonical_merge_version(spark: SparkSession, sf: str) -> DataFrame:
    stored = v.stored_events(spark, sf)
    changes = merge_changes(
        v.arriving_events(spark, sf), stored, CANONICAL_KEY, _ORDER, versioned=True,
        now=F.lit(v.NOW).cast("timestamp"),
    )
    merged = snapshot(stored, written(changes, "changes"), CANONICAL_KEY)
    return merged.select("record_id", "content_hash", "version")


CANONICAL_MERGE_VERSION = f"""WITH {v.EVENT_WRITES}
SELECT record_id, arg_max(content_hash, (fetched_at, seq)) AS content_hash,
  count(*)::INTEGER AS version
FROM event_writes WHERE is_write GROUP BY record_id"""


def collect_metrics(spark: SparkSession, sf: str) -> DataFrame:
    actions = merge_actions(
        v.arriving_events(spark, sf), v.stored_events(spark, sf), RAW_KEY, _ORDER
    )
    return actions.agg(
        F.sum("n_writes").alias("items_collected"), F.sum("n_skips").alias("items_skipped")
    )


COLLECT_METRICS = f"""WITH {v.EVENT_WRITES}
SELECT count(*) FILTER (is_write) AS items_collected,
  count(*) FILTER (NOT is_write) AS items_skipped
FROM event_writes WHERE NOT early"""


def _tied(spark: SparkSession, sf: str) -> DataFrame:
    """Events merged into a table in two batches by their day alone, so that many rows tie."""
    table = RecordTable(scratch_path(spark, "tied"), _EVENT_TABLE, RAW_KEY, ("source_name",))
    events = v.event_records(spark, sf).withColumn("fetched_at", F.date_trunc("day", "fetched_at"))
    early = F.col("fetched_at") < F.lit(v.SPLIT).cast("timestamp")
    for number, batch in enumerate((events.filter(early), events.filter(~early))):
        stored = table.read(spark, columns=("content_hash",))
        table.write_batch(merge_changes(batch, stored, RAW_KEY, ("fetched_at",)), number)
    return table.read(spark)


def merge_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _tied(spark, sf).select(*RAW_KEY, "content_hash")


# rows of one day count as applied in the order of their hashes
MERGE_WITH_TIES = f"""WITH {v.EVENT_RECORDS}
SELECT source_name, source_id,
  arg_max(content_hash, (date_trunc('day', fetched_at), content_hash)) AS content_hash
FROM event_records GROUP BY ALL"""


def key_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return key_violations(_tied(spark, sf), RAW_KEY).agg(F.count("*").alias("violations"))


KEY_UNIQUENESS = f"""WITH {v.EVENT_WRITES},
stored AS (
  SELECT record_id, arg_max(seq, (fetched_at, seq)) AS seq FROM event_writes
  WHERE early AND is_write GROUP BY record_id
)
SELECT count(*) AS violations
FROM (SELECT record_id FROM stored GROUP BY record_id HAVING count(*) > 1)"""


def latest_ids(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_source(v.event_records(spark, sf), tie="seq")


LATEST_IDS = f"""WITH {v.EVENT_RECORDS}
SELECT source_name, arg_max(source_id, (fetched_at, seq)) AS source_id
FROM event_records GROUP BY source_name"""


def take_until(spark: SparkSession, sf: str) -> DataFrame:
    """Event records read newest first, up to the id stored last before the split."""
    early = v.event_records(spark, sf).filter(F.col("fetched_at") < F.lit(v.SPLIT).cast("timestamp"))
    newest_first = v.event_records(spark, sf).withColumn("seq", -F.col("seq"))
    rows = take_until_checkpoint(newest_first, latest_per_source(early, tie="seq"))
    return rows.select("source_name", "source_id", "seq")


TAKE_UNTIL = f"""WITH {v.EVENT_RECORDS},
marks AS (
  SELECT source_name, arg_max(source_id, (fetched_at, seq)) AS mark FROM event_records
  WHERE fetched_at < TIMESTAMP '{v.SPLIT}' GROUP BY source_name
),
cuts AS (
  SELECT e.source_name, min(-e.seq) AS cut FROM event_records e
  JOIN marks m ON e.source_name = m.source_name AND e.source_id = m.mark GROUP BY e.source_name
)
SELECT e.source_name, e.source_id, -e.seq AS seq FROM event_records e
LEFT JOIN cuts c ON e.source_name = c.source_name WHERE c.cut IS NULL OR -e.seq < c.cut"""


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    row = get_raw(v.notices(spark, sf), "src_a", "N-42")
    return row.select("source_name", "source_id", "title", "amount")


POINT_LOOKUP = f"""WITH {v.NOTICES}
SELECT source_name, source_id, title, amount FROM notices
WHERE source_name = 'src_a' AND source_id = 'N-42'"""


def find_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.canonical(spark, sf)
    return find(rows, F.col("estimated_value") > 100000, limit=100, skip=50).select(
        "record_id", "title", "estimated_value"
    )


FIND_PAGE = f"""WITH {v.CANONICAL_VIEW}
SELECT record_id, title, estimated_value FROM canonical WHERE estimated_value > 100000
ORDER BY record_id LIMIT 100 OFFSET 50"""


def find_count(spark: SparkSession, sf: str) -> DataFrame:
    return count(v.canonical(spark, sf), F.col("vendor_normalized").isNotNull())


FIND_COUNT = f"""WITH {v.CANONICAL_VIEW}
SELECT count(*) AS count FROM canonical WHERE vendor_normalized IS NOT NULL"""


def new_or_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving event records whose stored form is missing or differs."""
    rows = only_new(v.arriving_events(spark, sf), v.stored_events(spark, sf))
    return rows.select("source_name", "source_id", "seq")


NEW_OR_CHANGED = f"""WITH {v.EVENT_WRITES},
stored AS (
  SELECT record_id, arg_max(content_hash, (fetched_at, seq)) AS content_hash FROM event_writes
  WHERE early GROUP BY record_id
)
SELECT source_name, source_id, seq FROM event_writes e WHERE NOT early AND NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.record_id = e.record_id AND s.content_hash = e.content_hash)"""

QUERIES = {
    "raw_merge_actions": (raw_merge_actions, RAW_MERGE_ACTIONS),
    "raw_merge": (raw_merge, RAW_MERGE),
    "table_merge": (table_merge, RAW_MERGE),
    "canonical_merge_version": (canonical_merge_version, CANONICAL_MERGE_VERSION),
    "collect_metrics": (collect_metrics, COLLECT_METRICS),
    "merge_with_ties": (merge_with_ties, MERGE_WITH_TIES),
    "key_uniqueness": (key_uniqueness, KEY_UNIQUENESS),
    "latest_per_source": (latest_ids, LATEST_IDS),
    "take_until_checkpoint": (take_until, TAKE_UNTIL),
    "point_lookup": (point_lookup, POINT_LOOKUP),
    "find_page": (find_page, FIND_PAGE),
    "find_count": (find_count, FIND_COUNT),
    "new_or_changed": (new_or_changed, NEW_OR_CHANGED),
}
