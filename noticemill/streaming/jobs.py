"""Streams of landed pages into the raw table, and of raw batches into the canonical table.

Each micro-batch is merged like a batch job and written as the table batch with the same number,
so a batch that runs again after a failure replaces its own output. ``first_batch`` is added to the
number: a table that has batches of another job or of an earlier stream needs it, and it must stay
the same for one checkpoint folder.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticemill.operators.merge import apply_actions, merge_actions, merge_changes
from noticemill.operators.quality import has_required, split_valid
from noticemill.operators.tables import RecordTable
from noticemill.plans.curate import classify_records, to_canonical
from noticemill.plans.ingest import collect_counts
from noticemill.schemas import CANONICAL_KEY, RAW_KEY
from noticemill.session import path_exists, written
from noticemill.sources.spec import (
    ARRIVAL,
    explode_pages,
    get_source,
    pages_to_read,
    records,
    stamp,
    unreadable,
)


def merge_stream(
    rows: DataFrame,
    table: RecordTable,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    versioned: bool = False,
    name: str | None = None,
    first_batch: int = 0,
) -> StreamingQuery:
    """Merge a stream of records into a table until all available input is read."""

    def merge(batch: DataFrame, number: int) -> None:
        at = first_batch + number
        held = [c for c in ("content_hash", "version", "created_at") if c in table.schema.names]
        arriving = written(batch, "arriving")
        stored = table.read(batch.sparkSession, at, held, among=arriving)
        table.write_batch(merge_changes(arriving, stored, keys, order, versioned=versioned), at)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True).start()


def _state(table: RecordTable, spark: SparkSession, before: int) -> tuple:
    """The folders that a table is read from."""
    return tuple(map(tuple, table.finished(spark, before)))


def ingest_stream(
    spark: SparkSession,
    source: str,
    path: str,
    table: RecordTable,
    checkpoint: str,
    fetched_at: Column | None = None,
    first_batch: int = 0,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Landed pages of one source into the raw table; Spark's checkpoint remembers the files.

    ``files_per_batch`` bounds what one micro-batch reads.
    """
    spec = get_source(source)
    options = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    pages = spec.stream_pages(spark, path, **options)
    moment = F.current_timestamp() if fetched_at is None else fetched_at
    mine = F.col("source_name") == source
    # the newest stored time, in microseconds, and the folders of the table that it holds for
    known: dict[tuple, int | None] = {}

    def newest_time(session: SparkSession, at: int) -> int | None:
        if _state(table, session, at) in known:
            return known[_state(table, session, at)]
        return table.read(session, at, ("fetched_at",), mine).agg(F.unix_micros(F.max("fetched_at"))).first()[0]

    def merge(batch: DataFrame, number: int) -> None:
        at = first_batch + number
        session = batch.sparkSession
        # a micro-batch is pages, so it is read as the batch job reads them
        landed = written(batch, "pages")
        rows = records(spec, explode_pages(pages_to_read(landed, one_run=spec.one_run)))
        newest = newest_time(session, at)
        moments = session.range(1).select(F.timestamp_micros(F.lit(newest).cast("long")).alias("fetched_at"))
        arriving = written(stamp(rows, moment, moments), "arriving")
        # what is stored of other keys does not matter, and there is more of it with every micro-batch
        stored = table.read(session, at, ("content_hash",), mine, among=arriving)
        actions = written(merge_actions(arriving, stored, RAW_KEY, ARRIVAL), "actions")
        table.write_batch(apply_actions(arriving, actions, RAW_KEY, ARRIVAL), at)
        last = table.read_batch(session, at).agg(F.unix_micros(F.max("fetched_at"))).first()[0]
        known.clear()
        known[_state(table, session, at + 1)] = max((t for t in (newest, last) if t is not None), default=None)
        bad = unreadable(landed, source)
        n_bad = 0 if bad is None else table.write_aside(bad, "unreadable", at)
        counts = collect_counts(actions).withColumn("failures", F.lit(n_bad).cast("long"))
        table.write_aside(counts, "metrics", at)

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_metrics(spark: SparkSession, table: RecordTable) -> DataFrame:
    """One row over all micro-batches: items_collected, items_skipped, and the pages that could
    not be read as failures. A batch that ran again counts once."""
    sums = [F.sum(c).alias(c) for c in ("items_collected", "items_skipped", "failures")]
    return table.read_aside(spark, "metrics").agg(*sums)


def curate_stream(
    raw_rows: DataFrame,
    table: RecordTable,
    model: PipelineModel,
    checkpoint: str,
    order: Sequence[str] = ("batch",),
    first_batch: int = 0,
) -> StreamingQuery:
    """A stream of raw records, such as ``raw_table(..).stream(spark)``, into the canonical table;
    a raw batch has one row per key, so its number is the order. Rows that fail validation go to the
    folder ``quarantine`` of the table with their reasons."""

    def merge(batch: DataFrame, number: int) -> None:
        at = first_batch + number
        normal = written(to_canonical(batch, keep=order), "normal")
        stored = table.read(
            batch.sparkSession, at, ("content_hash", "version", "created_at"), among=normal
        )
        changes = merge_changes(has_required(normal), stored, CANONICAL_KEY, order, versioned=True)
        table.write_batch(classify_records(changes, model), at)
        table.write_aside(split_valid(normal)[1], "quarantine", at)

    writer = raw_rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


#: Groups that keys are dealt to by their hash, each with one state. A checkpoint folder keeps the number.
KEY_GROUPS = 1024
#: What the state store holds of a group: an Arrow table with a row per key.
GROUP_STATE = "known binary"
_KNOWN = pa.schema(
    [("key", pa.string()), ("content_hash", pa.string()), ("version", pa.int32()), ("created_at", pa.int64())]
)


def _key_text(schema: T.StructType, keys: Sequence[str]) -> Column:
    """A text that rows share if and only if their keys are equal, null with null."""

    def text(name: str) -> Column:
        kind, value = schema[name].dataType, F.col(name)
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(value).cast("string")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (value + F.lit(0.0)).cast("string")  # -0.0 is 0.0
        if isinstance(kind, T.BinaryType):
            return F.hex(value)
        return value.cast("string")

    return F.to_json(F.array(*map(text, keys)), {"ignoreNullFields": "false"})


def keyed_changes(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: T.StructType, groups: int = KEY_GROUPS
) -> DataFrame:
    """The changed rows of a stream of records, at most one per key and micro-batch, with the columns of
    ``schema``. The hash and version of every key are kept in the state store, so no stored table is
    read. Rows of a key count as applied one by one, in ``order`` and then by their hashes; the last
    one is the one that is kept, with one version more for each change.

    Keys are dealt to ``groups`` groups by their hash. A group has one state with what is known of all its
    keys, and its rows are handled together, as the call for a group costs as much as thousands of rows. All
    rows of a group in a micro-batch meet in one task: what a micro-batch reads bounds them. A
    checkpoint folder belongs to one number of groups.
    """
    names = schema.names
    held = [n for n in names if n not in ("version", "created_at", "updated_at")]
    read = list(dict.fromkeys([*held, *keys, *order, "content_hash"]))
    moments = [n for n in ("created_at", "updated_at") if n in names]
    # pandas would make floats of whole numbers with nulls among them, and round the large ones
    whole = [n for n in read if isinstance(rows.schema[n].dataType, T.LongType)]

    def apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(parts), ignore_index=True)
        for k, name in enumerate(whole):
            found[name] = pd.arrays.IntegerArray(found[name].to_numpy(), found[f"_null{k}"].to_numpy())
        if state.exists:
            known = pa.ipc.open_stream(state.get[0]).read_all().to_pandas()
        else:
            known = _KNOWN.empty_table().to_pandas()
        places, distinct = pd.factorize(pd.concat([known["key"], found["_key"]], ignore_index=True))
        hashes = pd.factorize(pd.concat([known["content_hash"], found["content_hash"]], ignore_index=True))[0]
        old = len(known)  # the known keys are distinct, so they have the places before the new ones
        found["_place"], found["_content"] = places[old:], hashes[old:]
        found = found.sort_values(["_place", *order, "content_hash"], kind="stable")
        place, content = found["_place"].to_numpy(), found["_content"].to_numpy()
        opens = np.append(True, place[1:] != place[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(place)) - 1
        changed = np.append(True, content[1:] != content[:-1])
        at = place[first]
        stored = at < old
        changed[first] = True
        changed[first[stored]] = content[first[stored]] != hashes[at[stored]]
        changes = np.add.reduceat(changed.astype(np.int64), first)
        kept = changes > 0
        if not kept.any():
            return
        at, changes, out = at[kept], changes[kept], found.iloc[last[kept]]
        now = out["_now"].to_numpy(dtype=np.int64)
        version = np.zeros(len(distinct), dtype=np.int64)
        version[:old] = known["version"]
        created = np.zeros(len(distinct), dtype=np.int64)
        created[:old] = known["created_at"]
        latest = np.append(known["content_hash"].to_numpy(dtype=object), np.full(len(distinct) - old, None))
        created[at] = np.where(at < old, created[at], now)
        version[at] += changes
        latest[at] = out["content_hash"].to_numpy(dtype=object)
        columns = [distinct, pd.Series(latest, dtype=object), version, created]
        table = pa.Table.from_arrays(
            [pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _KNOWN, strict=True)], schema=_KNOWN
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KNOWN) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        yield out.assign(version=version[at], created_at=created[at], updated_at=now)[names]

    # times of the job travel as microseconds, whatever the time zone of the session
    sent = T.StructType(
        [T.StructField(f.name, T.LongType() if f.name in moments else f.dataType) for f in schema.fields]
    )
    now = F.unix_micros(F.current_timestamp()).alias("_now")
    text = _key_text(rows.schema, keys)
    empty = [F.col(n).isNull().alias(f"_null{k}") for k, n in enumerate(whole)]
    sent_rows = [F.coalesce(n, F.lit(0)).alias(n) if n in whole else F.col(n) for n in read]
    stamped = rows.select(*sent_rows, *empty, now, text.alias("_key"))
    dealt = stamped.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
    changes = dealt.groupBy("_group").applyInPandasWithState(
        apply, sent, GROUP_STATE, "update", GroupStateTimeout.NoTimeout
    )
    return changes.withColumns({n: F.timestamp_micros(n) for n in moments})


def merge_keyed_stream(
    rows: DataFrame,
    table: RecordTable,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    first_batch: int = 0,
) -> StreamingQuery:
    """As ``merge_stream`` with versions, but what is known of a key comes from the state store, which
    lives in the checkpoint folder, and not from the table. The table is only written, so it must have no
    rows that the stream has not seen."""

    def write(batch: DataFrame, number: int) -> None:
        table.write_batch(batch, first_batch + number)

    changes = keyed_changes(rows, keys, order, table.schema)
    writer = changes.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Counts per day, one row a day; the last batch that touched a day has its count.
DAILY = T.StructType([T.StructField("day", T.DateType()), T.StructField("count", T.LongType())])
LATE, WATERMARKS = "late", "watermarks"


def daily_table(path: str) -> RecordTable:
    return RecordTable(path, DAILY, ("day",), ("day",))


def daily_counts_stream(
    rows: DataFrame,
    table: RecordTable,
    checkpoint: str,
    delay: str = "1 day",
    time: str = "fetched_at",
    first_batch: int = 0,
) -> StreamingQuery:
    """Rows per day of their event time, in UTC, added up over micro-batches into ``daily_table``.

    The watermark of a micro-batch is the newest event time of those before it, less ``delay``. A day that
    ended by then is closed: rows that come for it later are not counted but kept aside under
    ``LATE``, with the watermark that they missed. Rows without a time are kept there too. A
    micro-batch that runs again replaces its counts, its late rows and its watermark.
    """

    def count(batch: DataFrame, number: int) -> None:
        at = first_batch + number
        spark = batch.sparkSession
        arriving = written(batch, "arriving")
        mark = watermark(spark, table, at, delay)
        day = F.date_trunc("day", time)
        ended = F.coalesce(day + F.expr("INTERVAL 1 DAY") <= F.lit(mark).cast("timestamp"), F.lit(False))
        closed = F.col(time).isNull() | ended
        missed = F.lit(mark).cast("timestamp").alias("watermark")
        table.write_aside(arriving.filter(closed).select("*", missed), LATE, at)
        added = arriving.filter(~closed).groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
        stored = table.read(spark, at).withColumnRenamed("count", "before")
        total = F.col("n") + F.coalesce("before", F.lit(0))
        table.write_batch(added.join(stored, "day", "left").select("day", total.alias("count")), at)
        newest = arriving.agg(F.max(time).alias("newest"))
        table.write_aside(newest, WATERMARKS, at)

    writer = rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def watermark(
    spark: SparkSession, table: RecordTable, before: int, delay: str
) -> datetime.datetime | None:
    """The newest event time of the batches before this one, less the delay; none before the first."""
    if not path_exists(spark, f"{table.path}/{WATERMARKS}"):
        return None
    seen = table.read_aside(spark, WATERMARKS).filter(F.col("batch") < before)
    return seen.agg(F.max("newest") - F.expr(f"INTERVAL {delay}")).first()[0]
