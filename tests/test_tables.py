import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.operators.tables import RecordTable, raw_table
from noticemill.schemas import RAW


def rows(spark, *items):
    at = dt.datetime(2024, 1, 1)
    data = [(i, "s", f"u/{i}", at, None, {"v": v}, v) for i, v in items]
    return spark.createDataFrame(data, RAW)


def seen(table, spark, before=None):
    return {r.source_id: r.content_hash for r in table.read(spark, before).collect()}


def test_batches_and_compaction(spark, tmp_path):
    table = raw_table(str(tmp_path / "raw"))
    assert seen(table, spark) == {}
    assert table.next_batch(spark) == 0
    table.write_batch(rows(spark, ("1", "a"), ("2", "a")), 0)
    table.write_batch(rows(spark, ("2", "b"), ("3", "b")), 1)
    assert seen(table, spark) == {"1": "a", "2": "b", "3": "b"}
    assert seen(table, spark, before=1) == {"1": "a", "2": "a"}
    table.compact(spark)
    assert table.next_batch(spark) == 2
    table.write_batch(rows(spark, ("1", "c")), 2)
    table.write_batch(rows(spark, ("1", "d")), 3)
    assert seen(table, spark) == {"1": "d", "2": "b", "3": "b"}
    # a batch that runs again replaces its own rows only
    table.write_batch(rows(spark, ("1", "e"), ("4", "e")), 3)
    assert seen(table, spark) == {"1": "e", "2": "b", "3": "b", "4": "e"}


def test_unfinished_batches_are_not_read(spark, tmp_path):
    table = raw_table(str(tmp_path / "raw"))
    table.write_batch(rows(spark, ("1", "a")), 0)
    table.write_batch(rows(spark, ("1", "b")), 1)
    (tmp_path / "raw" / "batch=1" / "_SUCCESS").unlink()
    assert seen(table, spark) == {"1": "a"}


def test_reads_prune_columns_and_sources(spark, tmp_path):
    table = raw_table(str(tmp_path / "raw"))
    table.write_batch(rows(spark, ("1", "a"), ("2", "a")), 0)
    table.compact(spark)
    for number in (1, 2, 3):
        table.write_batch(rows(spark, ("2", f"b{number}"), (f"n{number}", "c")), number)
    read = table.read(spark, columns=("content_hash",), where=F.col("source_name") == "s")
    assert {r.source_id: r.content_hash for r in read.collect()} == {
        "1": "a", "2": "b3", "n1": "c", "n2": "c", "n3": "c",
    }
    plan = read._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("raw_html" not in line and "extracted" not in line for line in scans)
    assert all("EqualTo(source_name,s)" in line for line in scans)


def test_compaction_after_a_number_of_batches(spark, tmp_path):
    table = raw_table(str(tmp_path / "raw"))
    done = []
    for number in range(5):
        table.write_batch(rows(spark, ("1", str(number))), number)
        done.append(table.compact_after(spark, 2))
    assert done == [False, True, False, True, False]
    assert seen(table, spark) == {"1": "4"}
    # a job that runs its batch again finds it outside the base
    table.write_batch(rows(spark, ("1", "5")), 5)
    assert table.compact_after(spark, 1, before=5)
    table.write_batch(rows(spark, ("1", "6")), 5)
    assert seen(table, spark) == {"1": "6"}


def test_markers_turned_off_are_an_error(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        with pytest.raises(RuntimeError, match="_SUCCESS"):
            raw_table(str(tmp_path / "raw")).write_batch(rows(spark, ("1", "a")), 0)
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def rows_scanned(frame):
    """Rows that came out of the files, from the metrics of the scan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    text = plan.getClass().getSimpleName()
    plan = plan.executedPlan() if text == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_read_few_row_groups_of_a_base(spark, tmp_path):
    """Ids and hashes are spread over all files, so only Bloom filters can leave files out."""
    table = RecordTable(
        str(tmp_path / "t"), T.StructType.fromDDL("k string, content_hash string, day long"), ("k",), ("day",)
    )
    rows = spark.range(40_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("k"),
        F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256).alias("content_hash"),
        F.col("id").alias("day"),
    )
    table.write_batch(rows, 0)
    table.compact(spark)
    files = len(list((tmp_path / "t" / "base=0").glob("part-*.parquet")))
    assert files >= 4
    one = rows.filter("day = 12345").first()
    for name in ("k", "content_hash"):
        found = table.read(spark).filter(F.col(name) == one[name])
        assert [r.day for r in found.collect()] == [12345]
        assert rows_scanned(found) < 2.5 * 40_000 / files
        assert rows_scanned(table.read(spark).filter(F.col(name) == "0" * 64)) < 40_000 / files * 1.5
