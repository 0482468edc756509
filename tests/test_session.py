from noticemill.session import scratch_path, size_shuffles, written


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base)


def test_written(spark):
    df = written(spark.range(5).selectExpr("id", "id % 2 AS k"), "numbers")
    assert df.count() == 5
    assert "Range" not in df._jdf.queryExecution().toString()


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    (tmp_path / "data").write_bytes(b"x" * 50_000)
    try:
        assert size_shuffles(spark, str(tmp_path), "/nowhere") == int(before)
        monkeypatch.setattr("noticemill.session.PARTITION_BYTES", 1000)
        assert size_shuffles(spark, str(tmp_path)) == 50
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
