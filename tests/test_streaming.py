import datetime
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_sources import city_row, land_city, land_federal, notice

from noticemill.operators.classify import train_from_seed
from noticemill.operators.tables import RecordTable, canonical_table, raw_table
from noticemill.plans.ingest import collect
from noticemill.streaming.jobs import (
    KEY_GROUPS,
    LATE,
    curate_stream,
    daily_counts_stream,
    daily_table,
    ingest_stream,
    keyed_changes,
    merge_keyed_stream,
    stream_metrics,
    watermark,
)


def test_bounded_batches_of_city_pages(spark, tmp_path):
    landing = land_city(tmp_path / "c", [[city_row(1)], [city_row(2)], [city_row(1, pin="new")]])
    raw = raw_table(str(tmp_path / "raw"))
    ingest_stream(
        spark, "nyc_procurement", landing, raw, str(tmp_path / "c1"), files_per_batch=1
    ).awaitTermination()
    assert raw.next_batch(spark) == 3
    assert {r.source_id for r in raw.read(spark).collect()} == {"r1", "r2"}


def test_pages_to_canonical(spark, tmp_path):
    landing = tmp_path / "landing"
    raw = raw_table(str(tmp_path / "raw"))
    canonical = canonical_table(str(tmp_path / "canonical"))
    model = train_from_seed(spark)

    def run():
        ingest_stream(
            spark, "sam_gov", str(landing / "*"), raw, str(tmp_path / "c1"),
            fetched_at=F.lit("2024-01-01").cast("timestamp"), first_batch=100,
        ).awaitTermination()
        curate_stream(raw.stream(spark), canonical, model, str(tmp_path / "c2")).awaitTermination()
        stored = canonical.read(spark).collect()
        return {r.source_id: (r.title, r.version) for r in stored}

    land_federal(landing / "one", [[notice(1), notice(2)], [notice(3)]], total=100)
    assert run() == {"n1": ("T1", 1), "n2": ("T2", 1), "n3": ("T3", 1)}
    land_federal(landing / "two", [[notice(2, "2024-01-11"), notice(3), notice(4)]])
    assert run() == {"n1": ("T1", 1), "n2": ("T2", 2), "n3": ("T3", 1), "n4": ("T4", 1)}
    assert run() == {"n1": ("T1", 1), "n2": ("T2", 2), "n3": ("T3", 1), "n4": ("T4", 1)}


def test_landings_of_one_batch_apply_in_order(spark, tmp_path):
    landing = tmp_path / "landing"
    raw = raw_table(str(tmp_path / "raw"))
    # the same notice at the same place, three times, the last change being the first form again
    for i, title in enumerate(["A", "B", "A"]):
        path = land_federal(landing / str(i), [[notice(1, title=title), notice(2)]])
        os.utime(f"{path}/pages.json", (1_700_000_000 + i, 1_700_000_000 + i))
    ingest_stream(
        spark, "sam_gov", str(landing / "*"), raw, str(tmp_path / "c1")
    ).awaitTermination()
    stored = raw.read(spark).collect()
    assert {r.source_id: r.extracted["title"] for r in stored} == {"n1": "A", "n2": "T2"}
    assert len(stored) == 2


def test_stream_stops_at_the_total_and_counts_as_the_batch_job(spark, tmp_path):
    landing = land_federal(tmp_path / "f", [[notice(1), notice(1)], [notice(2)]], total=25)
    with open(f"{landing}/pages.json", "a") as file:
        file.write('\n{"offset": 0, "opportun')
    streamed, batched = raw_table(str(tmp_path / "s")), raw_table(str(tmp_path / "b"))
    ingest_stream(spark, "sam_gov", landing, streamed, str(tmp_path / "c1")).awaitTermination()
    summary = collect(spark, batched, {"sam_gov": landing}, 0).first()
    metrics = stream_metrics(spark, streamed).first()
    assert tuple(metrics) == (1, 1, 1)
    assert tuple(metrics) == (summary.items_collected, summary.items_skipped, summary.failures)
    assert [r.source_id for r in streamed.read(spark).collect()] == ["n1"]
    assert [r.source_id for r in batched.read(spark).collect()] == ["n1"]


KEYED = T.StructType(
    [
        T.StructField("k", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def replay(batches):
    """Hash and version per key, row by row."""
    known = {}
    for rows in batches:
        for k, _, content in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            if k not in known or known[k][0] != content:
                known[k] = (content, known.get(k, (None, 0))[1] + 1)
    return known


def test_keyed_state_survives_restarts(spark, tmp_path):
    """Each run goes on from the state of the one before; a third of the rows are one key's."""
    rng = random.Random(6)
    batches = [
        [(7 if rng.random() < 0.33 else rng.randrange(12), 100 * run + k, rng.choice(["a", "b", None])) for k in range(60)]
        for run in range(3)
    ]
    table = RecordTable(str(tmp_path / "table"), KEYED, ("k",), ("k",))
    schema = "k long, seq long, content_hash string"
    written_before = {}
    for run, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        merge_keyed_stream(source, table, ("k",), ("seq",), str(tmp_path / "checkpoint")).awaitTermination()
        stored = {r.k: r for r in table.read(spark).collect()}
        assert {k: (r.content_hash, r.version) for k, r in stored.items()} == replay(batches[: run + 1])
        for k, first in written_before.items():
            assert stored[k].created_at == first
        written_before |= {k: r.created_at for k, r in stored.items()}
    # no new rows, no new batch
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = table.next_batch(spark)
    merge_keyed_stream(source, table, ("k",), ("seq",), str(tmp_path / "checkpoint")).awaitTermination()
    assert table.next_batch(spark) == before


def test_keyed_state_of_many_keys_in_one_group(spark, tmp_path):
    """Keys of several types, null among them, share the state of a group and keep apart."""
    rng = random.Random(9)
    batches = [
        [((rng.choice([None, "a", "null"]), rng.choice([None, 2**60, 2**60 + 1])), 200 * run + k, rng.choice(["a", "b", None])) for k in range(90)]
        for run in range(3)
    ]
    schema = "name string, n long, seq long, content_hash string"
    stored = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), *KEYED.fields[1:]])
    table = RecordTable(str(tmp_path / "table"), stored, ("name", "n"), ("n",))
    latest = {}
    for run, rows in enumerate(batches):
        flat = [(*key, seq, content) for key, seq, content in rows]
        spark.createDataFrame(flat, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes = keyed_changes(source, ("name", "n"), ("seq",), stored, groups=1)
        writer = changes.writeStream.outputMode("update").foreachBatch(lambda b, at: table.write_batch(b, at))
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        # a null key is no match for itself in a join, so the newest rows are taken here
        latest |= {(r["name"], r.n): (r.content_hash, r.version) for r in table.read_batch(spark, run).collect()}
        assert latest == replay(batches[: run + 1])


def test_keyed_state_takes_few_calls(spark, tmp_path):
    """One state per group, not per key: a call for each key costs more than its rows."""
    schema = "k long, seq long, content_hash string"
    rows = [(k, k, "a") for k in range(5000)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    table = RecordTable(str(tmp_path / "table"), KEYED, ("k",), ("k",))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = merge_keyed_stream(source, table, ("k",), ("seq",), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert table.read(spark).count() == 5000
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= KEY_GROUPS


def test_daily_counts_and_late_rows_add_up(spark, tmp_path):
    schema = "fetched_at timestamp, n long"
    table = daily_table(str(tmp_path / "days"))
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    runs = [
        [(day(3, 5), 1), (day(1, 23), 2), (day(3), 3), (None, 4)],
        [(day(1, 1), 5), (day(2, 1), 6), (day(2, 23), 7), (day(6), 8)],  # the watermark is 2 January, 5 h
        [(day(4, 2), 9), (day(5, 2), 10), (day(1), 11), (day(6, 1), 12)],  # now it is 5 January, 0 h
    ]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        daily_counts_stream(source, table, str(tmp_path / "checkpoint")).awaitTermination()
    counted = {r.day.day: r["count"] for r in table.read(spark).collect()}
    assert counted == {1: 1, 2: 2, 3: 2, 5: 1, 6: 2}
    late = sorted(r.n for r in table.read_aside(spark, LATE).collect())
    assert late == [4, 5, 9, 11]
    assert sum(counted.values()) + len(late) == sum(map(len, runs))
    # a micro-batch that runs again gives the same
    assert watermark(spark, table, 2, "1 day") == datetime.datetime(2024, 1, 5)


def test_micro_batches_read_what_is_stored_of_their_keys_only(spark, tmp_path, monkeypatch):
    """Rows as with the whole table beside them, and times that go on over micro-batches and streams."""
    asked = []
    read = RecordTable.read

    def reading(self, session, before=None, columns=None, where=None, among=None):
        found = read(self, session, before, columns, where, among)
        asked.append((before, among is not None, found.count()))
        return found

    landing = tmp_path / "landing"
    raw = raw_table(str(tmp_path / "raw"))
    for k, page in enumerate([[notice(1), notice(2)], [notice(3)], [notice(2, "2024-01-11"), notice(4)]]):
        folder = land_federal(landing, [page], total=100)
        os.rename(f"{folder}/pages.json", f"{folder}/{k}.json")
        os.utime(f"{folder}/{k}.json", (1000 + k, 1000 + k))
    monkeypatch.setattr(RecordTable, "read", reading)
    moment = F.lit("2024-01-01").cast("timestamp")
    ingest_stream(
        spark, "sam_gov", str(landing), raw, str(tmp_path / "c1"), fetched_at=moment, files_per_batch=1
    ).awaitTermination()
    # of three stored rows the last micro-batch reads one
    assert [(b, n) for b, among, n in asked if among] == [(0, 0), (1, 0), (2, 1)]
    # the newest time is looked for once
    assert [b for b, among, _ in asked if not among] == [0]
    monkeypatch.undo()
    land_federal(landing, [[notice(1, "2024-01-12")]], total=100)
    ingest_stream(
        spark, "sam_gov", str(landing), raw, str(tmp_path / "c1"), fetched_at=moment, files_per_batch=1
    ).awaitTermination()
    rows = raw.read(spark).select("source_id", F.unix_micros("fetched_at").alias("t"), F.col("extracted")["posted_date"].alias("d")).collect()
    start = min(r.t for r in rows) - 2  # n3 is third
    assert {(r.source_id, r.t - start, r.d) for r in rows} == {
        ("n3", 2, "2024-01-10"), ("n2", 3, "2024-01-11"), ("n4", 4, "2024-01-10"), ("n1", 5, "2024-01-12"),
    }


def test_reading_among_many_keys_reads_all(spark, tmp_path, monkeypatch):
    from noticemill.operators import tables

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.LongType())])
    table = RecordTable(str(tmp_path / "t"), schema, ("id",), ("id",))
    for batch, rows in enumerate([[("a", 1), (None, 2), ("b", 3)], [("a", 4), ("c", 5)]]):
        table.write_batch(spark.createDataFrame(rows, schema), batch)
        if not batch:
            table.compact(spark)
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "id string")
    got = {tuple(r) for r in table.read(spark, among=keys).collect()}
    assert got == {("a", 4), (None, 2)}
    monkeypatch.setattr(tables, "AMONG_ROWS", 3)
    assert {tuple(r) for r in table.read(spark, among=keys).collect()} == {("a", 4), (None, 2), ("b", 3), ("c", 5)}
