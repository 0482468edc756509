"""Record tables as Parquet folders.

Layout below one path::

    base=<n>/      the whole table as of batch n, clustered for pruning
    batch=<n>/     rows written by batch n
    <kind>/batch=<n>/   rows that batch n left out, such as unreadable pages

A merge writes only the rows it changes, into a folder named by its batch, so a repeated batch
replaces its own output and nothing else. Reading puts the newest row per key of the batches
after the base in place of the base's row. ``compact`` folds batches into a new base.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.operators.joins import is_small
from noticemill.schemas import CANONICAL, CANONICAL_KEY, RAW, RAW_KEY
from noticemill.session import path_exists

# jobs fold batches once so many lie behind the last base
COMPACT_AFTER = 32
# rows to read a table for, whose hashes of keys every task gets: 8 bytes each
AMONG_ROWS = 1 << 20
# columns beside the keys that rows are looked up by
HASHES = ("content_hash",)


@dataclass(frozen=True)
class RecordTable:
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    cluster_by: tuple[str, ...]

    def _folders(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the finished folders of one kind."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            match = re.fullmatch(rf"{kind}=(\d+)", status.getPath().getName())
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if match and fs.exists(done):
                found.append(int(match.group(1)))
        return sorted(found)

    def finished(self, spark: SparkSession, before: int | None = None) -> tuple[list[int], list[int]]:
        """Numbers of the bases, and of the batches after the newest of them, below ``before``."""
        limit = 2**62 if before is None else before
        bases = [n for n in self._folders(spark, "base") if n < limit]
        base_at = bases[-1] if bases else -1
        return bases, [n for n in self._folders(spark, "batch") if base_at < n < limit]

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        """Rows of the folders, with their number as the column of the folder's name."""
        kind = folders[0].split("=")[0]
        schema = T.StructType([*self.schema.fields, T.StructField(kind, T.LongType())])
        reader = spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{folder}" for folder in folders])

    def read_batch(self, spark: SparkSession, batch: int) -> DataFrame:
        """The rows one batch wrote."""
        return self._read(spark, [f"batch={batch}"]).drop("batch")

    def read(
        self,
        spark: SparkSession,
        before: int | None = None,
        columns: Sequence[str] | None = None,
        where: Column | None = None,
        among: DataFrame | None = None,
    ) -> DataFrame:
        """One row per key; ``before`` leaves out batches with that number or a later one.

        ``columns`` reads only these beside the keys. ``where`` is a condition on key columns;
        it and the choice of columns reach the files. Which batch has a key's newest row is found
        from the keys alone. ``among`` is a frame with the key columns: only rows with one of its keys
        are read, without a shuffle of the others, where it has at most ``AMONG_ROWS`` rows; beyond, all.
        """
        bases, batches = self.finished(spark, before)
        base_at = bases[-1] if bases else -1
        names = [
            f for f in self.schema.fieldNames() if columns is None or f in columns or f in self.keys
        ]

        def print_of_key() -> Column:
            return F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys])

        wanted = None
        if among is not None and (bases or batches) and is_small(among, AMONG_ROWS):
            wanted = F.broadcast(among.select(print_of_key().alias("_print")))

        def rows(folders: list[str], *more: str) -> DataFrame:
            found = self._read(spark, folders)
            if where is not None:
                found = found.filter(where)
            if wanted is not None:
                found = found.join(wanted, print_of_key() == wanted["_print"], "left_semi")
            return found.select(*names, *more)

        base = rows([f"base={base_at}"]) if bases else None
        if not batches:
            empty = T.StructType([self.schema[f] for f in names])
            return spark.createDataFrame([], empty) if base is None else base
        folders = [f"batch={n}" for n in batches]
        newest = rows(folders, "batch")
        if len(batches) > 1:
            last = rows(folders, "batch").groupBy(*self.keys).agg(F.max("batch").alias("batch"))
            newest = newest.join(last, [*self.keys, "batch"], "left_semi")
        newest = newest.drop("batch")
        if base is None:
            return newest
        kept = base.join(newest.select(*self.keys), list(self.keys), "left_anti")
        return kept.unionByName(newest)

    def stream(self, spark: SparkSession) -> DataFrame:
        """The batches as a stream of their rows, each with the number ``batch``."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        reader = spark.readStream.schema(schema).option("basePath", self.path)
        return reader.parquet(f"{self.path}/batch=*")

    def next_batch(self, spark: SparkSession) -> int:
        """The first number no finished batch or base has."""
        return 1 + max(self._folders(spark, "batch") + self._folders(spark, "base"), default=-1)

    def write_batch(self, changes: DataFrame, batch: int) -> None:
        """Write the rows of one batch; running the same batch again replaces them."""
        rows = changes.select(*self.schema.fieldNames())
        self._write(rows, f"{self.path}/batch={batch}")

    def _write(self, rows: DataFrame, folder: str, looked_up: Sequence[str] = ()) -> None:
        writer = rows.write.mode("overwrite")
        if looked_up:
            # filters of a size that the number of values in the row group asks for
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in looked_up:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(folder)
        if not path_exists(rows.sparkSession, f"{folder}/_SUCCESS"):
            raise RuntimeError(
                f"{folder} has no _SUCCESS: reading leaves out folders without it, so the cluster "
                "must not turn mapreduce.fileoutputcommitter.marksuccessfuljobs off"
            )

    def write_aside(self, rows: DataFrame, kind: str, batch: int) -> int:
        """Rows that do not go into the table, kept below it by batch; returns their number."""
        folder = f"{self.path}/{kind}/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder).count()

    def read_aside(self, spark: SparkSession, kind: str) -> DataFrame:
        """All rows kept under one kind, with the batch that left them out."""
        return spark.read.parquet(f"{self.path}/{kind}")

    def compact(self, spark: SparkSession, before: int | None = None) -> None:
        """Write a base that holds everything up to the newest batch, or the newest one before the
        given number. The batches stay: streams may read them, and so may a run that has begun.

        Range clustering cuts a large source or category into several files and lets row-group
        statistics prune on the cluster columns. Keys and hashes are spread over all of these files, so
        each row group has Bloom filters for them: a lookup by key or hash reads the row groups that
        hold it and hardly any other.
        """
        batches = [n for n in self._folders(spark, "batch") if before is None or n < before]
        if not batches:
            return
        rows = self.read(spark, before)
        clustered = rows.repartitionByRange(*self.cluster_by).sortWithinPartitions(*self.cluster_by)
        looked_up = [c for c in dict.fromkeys((*self.keys, *HASHES)) if c in self.schema.names]
        self._write(clustered, f"{self.path}/base={batches[-1]}", looked_up)

    def compact_after(
        self, spark: SparkSession, batches: int = COMPACT_AFTER, before: int | None = None
    ) -> bool:
        """Compact once so many batches lie behind the last base. A job gives its own batch as
        ``before``, so that what it may have to run again is never in a base."""
        limit = 2**62 if before is None else before
        bases = [n for n in self._folders(spark, "base") if n < limit]
        base_at = bases[-1] if bases else -1
        waiting = [n for n in self._folders(spark, "batch") if base_at < n < limit]
        if len(waiting) < batches:
            return False
        self.compact(spark, before)
        return True


def raw_table(path: str) -> RecordTable:
    return RecordTable(path, RAW, RAW_KEY, ("source_name", "fetched_at", "source_id"))


def canonical_table(path: str) -> RecordTable:
    return RecordTable(path, CANONICAL, CANONICAL_KEY, ("category", "status", "due_date", "record_id"))
