"""Token counts of whole texts, with a cache by content digest.

The cache is a table (digest, tokenizer, n_tokens) in a folder the caller names; of it only the digests
asked for are taken. A text's digest is
taken of its normalised content: for a vocabulary that drops white space, runs of white space count
as one space. Only distinct texts whose digest the cache lacks under the tokenizer's version are
encoded; their counts are appended. A text that a lost job appended twice has the same count twice,
and reading takes one.

Null text counts as empty: 0 tokens, and it is not encoded. Repeated rows and equal texts each get
the count of their text. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.encoder import Encoder, version
from noticemill.llm.frames import whole_text
from noticemill.session import scratch_path, written

CACHE = "digest string, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an unwritten cache is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def digest(text: Column, by_word: bool) -> Column:
    """Digest of the content that decides a text's count."""
    if by_word:
        text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.sha2(text, 256)


def count_tokens(
    docs: DataFrame,
    path: str,
    cache: str | None = None,
    limit: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. ``path`` is the vocabulary file, the same
    on every machine; ``cache`` is the folder of the cache (by default one that starts empty)."""
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-counts")
    by_word, tokenizer = Encoder(path).by_word, version(path)
    text = whole_text(text_column)
    keyed = written(
        docs.select(
            F.col(id_column).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest(text, by_word).alias("digest")
        ),
        "digests",
    )
    asked = keyed.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"))

    def stored() -> DataFrame:
        found = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer).join(asked, "digest", "left_semi")
        return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = (
        docs.select(digest(text, by_word).alias("digest"), text.alias("text"))
        .where(F.length("text") > 0)
        .dropDuplicates(["digest"])
        .join(stored().select("digest"), "digest", "left_anti")
    )
    counted = missing.mapInArrow(_counter(path), "digest string, n_tokens long")
    counted.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # as a table of its own, so that both sides of the join are plain shuffles, which AQE splits at hot digests
    counts = written(stored(), "counts")
    n_tokens = F.coalesce("n_tokens", F.lit(0).cast("long"))
    return keyed.join(counts, "digest", "left").select(
        F.col("id").alias(id_column), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for part in encoder.encode(batch.column("text")):
                counts[part.first : part.last] = np.diff(part.of)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts)], ["digest", "n_tokens"])

    return count
