import random

import pytest
from pyspark.sql import functions as F

from noticemill.operators.merge import key_violations, merge_actions, merge_changes, snapshot

SCHEMA = "k string, seq long, content_hash string"
STORED = "k string, seq long, content_hash string, version int, created_at timestamp"


def replay(stored, batch, force=False):
    """Row by row, the way the merge is defined."""
    table = {k: (s, h, v) for k, s, h, v in stored}
    writes = dict.fromkeys((k for k, _, _ in batch), 0)
    for k, s, h in sorted(batch, key=lambda r: (r[0], r[1])):
        old = table.get(k)
        if old is not None and old[1] == h and not force:
            continue
        table[k] = (s, h, (old[2] if old else 0) + 1)
        writes[k] += 1
    return table, writes


def frames(spark, stored, batch):
    current = spark.createDataFrame(
        [(k, s, h, v, None) for k, s, h, v in stored], STORED
    )
    return current, spark.createDataFrame(batch, SCHEMA).repartition(5)


def merged(spark, current, batch, force=False):
    changes = merge_changes(
        batch, current, ["k"], ["seq"], versioned=True, now=F.lit("2024-01-01").cast("timestamp"),
        force=force,
    )
    rows = snapshot(current, changes, ["k"]).collect()
    return {r.k: (r.seq, r.content_hash, r.version) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("force", [False, True])
def test_merge_equals_replay(spark, seed, force):
    rng = random.Random(seed)
    hashes = ["a", "b", None]
    stored = [(f"k{i}", 0, rng.choice(hashes), rng.randint(1, 4)) for i in range(0, 40, 2)]
    batch = [(f"k{rng.randrange(60)}", i, rng.choice(hashes)) for i in range(1, 400)]
    # one key holds more than a third of the rows, enough to span several ranges
    batch += [("hot", 1000 + i, rng.choice("ab")) for i in range(1500)]
    rng.shuffle(batch)
    current, incoming = frames(spark, stored, batch)
    table, writes = replay(stored, batch, force)
    assert merged(spark, current, incoming, force) == table
    actions = merge_actions(incoming, current, ["k"], ["seq"], force=force).collect()
    assert {a.k: a.n_writes for a in actions} == writes
    known = {k for k, *_ in stored}
    for a in actions:
        wanted = "skip" if writes[a.k] == 0 else ("update" if a.k in known else "insert")
        assert a.action == wanted
        assert a.n_rows == a.n_writes + a.n_skips


def test_hot_key_is_cut_into_ranges(spark):
    from noticemill.operators.merge import _ranges

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        batch = spark.range(4000).select(
            F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("content_hash")
        )
        parts = _ranges(batch, ["k"], ["seq"], "content_hash").collect()
        assert len(parts) > 4
        assert max(p["_rows"] for p in parts) < 1500
        empty = spark.createDataFrame([], "k string, content_hash string")
        row = merge_actions(batch, empty, ["k"], ["seq"]).first()
        assert (row.n_rows, row.n_writes, row.action) == (4000, 4000, "insert")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_there_and_back_is_two_changes(spark):
    current, batch = frames(spark, [("x", 0, "a", 1)], [("x", 1, "b"), ("x", 2, "a"), ("x", 3, "a")])
    assert merged(spark, current, batch) == {"x": (2, "a", 3)}


def test_second_run_writes_nothing(spark):
    rows = [("x", 1, "b"), ("y", 2, "a")]
    current, batch = frames(spark, [], rows)
    once = merge_changes(batch, current, ["k"], ["seq"], versioned=True)
    again = merge_changes(batch, once, ["k"], ["seq"], versioned=True)
    assert once.count() == 2
    assert again.count() == 0


def test_first_creation_time_is_kept(spark):
    current = spark.createDataFrame([("x", 0, "a", 1)], "k string, seq long, content_hash string, version int")
    current = current.withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    batch = spark.createDataFrame([("x", 1, "b"), ("y", 1, "b")], SCHEMA)
    now = F.lit("2024-01-01").cast("timestamp")
    changes = merge_changes(batch, current, ["k"], ["seq"], versioned=True, now=now)
    got = {r.k: (str(r.created_at)[:4], str(r.updated_at)[:4]) for r in changes.collect()}
    assert got == {"x": ("2020", "2024"), "y": ("2024", "2024")}


def test_key_violations(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert [(r.k, r.n_rows) for r in key_violations(df, ["k"]).collect()] == [("x", 2)]


def test_ties_leave_one_row_per_key(spark):
    batch = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 2, "z"), ("b", 2, "z")]
    stored, rows = frames(spark, [], batch)
    for parts in (1, 5):
        got = merge_changes(rows.repartition(parts), stored.drop("version"), ("k",), ("seq",)).collect()
        assert sorted((r.k, r.content_hash) for r in got) == [("a", "y"), ("b", "z")]
