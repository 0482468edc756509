"""Session settings and the shared folder used for tables that jobs write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the JVM does not compile larger methods, so wide projections run faster without fusion
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.broadcastTimeout": "3600",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "noticemill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


PARTITION_BYTES = 256 << 20
MOST_PARTITIONS = 100_000


def _stored_bytes(spark: SparkSession, place) -> int:
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


TEXT_BYTES = 8 << 20


def text_partitions(df: DataFrame) -> int:
    """How many partitions spread the files the frame is read from to about TEXT_BYTES each: words take
    many times the bytes of their stored text. At least one per core."""
    spark = df.sparkSession
    uri = spark._jvm.java.net.URI
    size = sum(_stored_bytes(spark, spark._jvm.org.apache.hadoop.fs.Path(uri(file))) for file in df.inputFiles())
    return max(spark.sparkContext.defaultParallelism, min(-(-size // TEXT_BYTES), MOST_PARTITIONS))


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Raise spark.sql.shuffle.partitions so that the files below the paths spread to about
    PARTITION_BYTES each; AQE merges what turns out small, but it cannot cut a hash partition."""
    size = 0
    for path in paths:
        size += _stored_bytes(spark, spark._jvm.org.apache.hadoop.fs.Path(path))
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(now, min(-(-size // PARTITION_BYTES), MOST_PARTITIONS))
    if wanted > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, for heavy work on them: a small table is one file of one row group
    and would be one task. A table with as many parts as there are cores is left alone. Meant for
    frames read straight from files, where the number of parts is known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local-mode session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(base)
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/noticemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read by several later steps."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
