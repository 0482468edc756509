import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from noticemill.functions.hashing import content_hash
from noticemill.operators import similarity
from noticemill.operators.classify import train_from_seed
from noticemill.operators.quality import split_valid
from noticemill.operators.tables import canonical_table, raw_table
from noticemill.plans.curate import curate, process, to_canonical
from noticemill.plans.ingest import as_json
from noticemill.schemas import CANONICAL, RAW


@pytest.fixture(scope="module")
def model(spark):
    return train_from_seed(spark)


def raw(spark, *items):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", i, f"https://x/{i}", at, None, ext) for i, ext in items]
    schema = (
        "source_name string, source_id string, source_url string, fetched_at timestamp,"
        " raw_html string, extracted map<string,string>"
    )
    df = spark.createDataFrame(rows, schema).withColumn("content_hash", content_hash("extracted"))
    return df.select(*RAW.fieldNames())


def test_projection(spark):
    ext = {
        "title": "T", "agency": "A", "publish_date": "2024-03-01", "posted_date": "",
        "deadline": "03/15/2024", "amount": "$5", "awardee": "Acme, Inc.", "contact": "me",
    }
    row = to_canonical(raw(spark, ("1", ext))).first()
    assert row.record_id == hashlib.sha256(b"s:1").hexdigest()
    assert (row.title, row.agency, row.description, row.location) == ("T", "A", "", "")
    assert row.posted_date == dt.datetime(2024, 3, 1)
    assert row.due_date == dt.datetime(2024, 3, 15)
    assert row.award_date is None
    assert (row.estimated_value, row.currency) == (5.0, "USD")
    assert (row.vendor_name, row.vendor_normalized) == ("Acme, Inc.", "acme,")
    assert (row.contact_info, row.status, row.category) == ("me", "unknown", "other")
    assert (row.version, row.category_confidence, row.tags) == (1, 0.0, [])
    assert to_canonical(raw(spark, ("1", ext))).columns == CANONICAL.fieldNames()


def test_validation(spark):
    good = to_canonical(raw(spark, ("1", {"title": "T"})))
    bad = good.withColumn("status", F.lit("odd")).withColumn("category_confidence", F.lit(1.5))
    valid, quarantine = split_valid(good.unionByName(bad))
    assert valid.count() == 1
    assert quarantine.first().reasons == ["confidence out of range", "unknown status"]


def test_curate(spark, model):
    same = {"title": "Highway bridge construction", "description": "road paving project"}
    rows = raw(spark, ("1", same), ("2", same), ("3", {"title": "Cloud software cybersecurity"}))
    done = curate(rows, spark.createDataFrame([], CANONICAL), model)
    summary = done.summary().first()
    assert (summary.processed, summary.upserted, summary.duplicates_flagged) == (3, 3, 1)
    got = {r.source_id: (r.category, r.version) for r in done.changes().collect()}
    assert got == {"1": ("construction", 1), "2": ("construction", 1), "3": ("it_services", 1)}
    assert as_json(done.summary()).first().summary == (
        '{"processed":3,"upserted":3,"duplicates_flagged":1}'
    )


def test_rows_without_required_fields_are_quarantined(spark, model):
    rows = raw(spark, ("1", {"title": "x"}), ("2", {"title": "y"}))
    rows = rows.withColumn("source_url", F.when(F.col("source_id") == "1", F.col("source_url")))
    done = curate(rows, spark.createDataFrame([], CANONICAL), model)
    assert [r.source_id for r in done.records().collect()] == ["1"]
    assert [(r.source_id, r.reasons) for r in done.quarantine().collect()] == [
        ("2", ["missing source_url"])
    ]


def test_process_runs(spark, model, tmp_path):
    source, target = raw_table(str(tmp_path / "raw")), canonical_table(str(tmp_path / "can"))
    source.write_batch(raw(spark, ("1", {"title": "a road"}), ("2", {"title": "a server"})), 0)
    first = process(spark, source, target, model, 0).first()
    assert (first.processed, first.upserted) == (2, 2)
    again = process(spark, source, target, model, 1).first()
    assert (again.processed, again.upserted) == (2, 0)
    source.write_batch(raw(spark, ("1", {"title": "another road"})), 1)
    changed = process(spark, source, target, model, 2, incremental=True).first()
    assert (changed.processed, changed.upserted) == (1, 1)
    got = {r.source_id: (r.title, r.version) for r in target.read(spark).collect()}
    assert got == {"1": ("another road", 2), "2": ("a server", 1)}


def test_process_keeps_invalid_rows_aside(spark, model, tmp_path):
    source, target = raw_table(str(tmp_path / "raw")), canonical_table(str(tmp_path / "can"))
    rows = raw(spark, *[(str(k), {"title": f"a road {k}"}) for k in range(4)])
    source.write_batch(
        rows.withColumn("source_url", F.when(F.col("source_id") != "2", F.col("source_url"))), 0
    )
    first = process(spark, source, target, model, 0).first()
    assert (first.processed, first.upserted, first.quarantined) == (3, 3, 1)
    kept = target.read_aside(spark, "quarantine").collect()
    assert [(r.source_id, r.reasons) for r in kept] == [("2", ["missing source_url"])]
    forced = process(spark, source, target, model, 1, force=True).first()
    assert (forced.processed, forced.upserted, forced.quarantined) == (3, 3, 1)
    assert {r.version for r in target.read(spark).collect()} == {2}


def test_a_summary_shuffles_no_vector_per_block(spark, monkeypatch):
    """Its near-duplicates come from many blocks, each stored once."""
    words = " ".join(f"word{k}" for k in range(300))
    items = [(f"{k}", {"title": f"T{k}", "description": f"{words} extra{k:02d}"}) for k in range(40)]
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)

    def moved(*_):
        raise AssertionError("vectors are shuffled once per block")

    monkeypatch.setattr(similarity, "in_blocks", moved)
    done = curate(raw(spark, *items), spark.createDataFrame([], CANONICAL), None)
    assert done.summary().first().asDict() == {"processed": 40, "upserted": 40, "duplicates_flagged": 40 * 39 // 2}
