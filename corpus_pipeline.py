"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet in the
shared folder and reads it again as the next one's docs. All but the last return the columns of
documents.

1. toxicity: documents that the classifier behind disguises rejects go. It learns from ``labels``.
2. exact: one document of each group of texts that are equal but for white space stays.
3. near: one document of each group of near-duplicates stays.
4. mix: documents come as often as the mix of sources holds them, none to several times.
5. pack: the pieces of the documents in sequences of 2048 tokens.

Null texts count as empty; they are clean, copies of each other, near to nothing, and come as often as
the mix of their source holds them. Rows without an id and rows that repeat one are documents like others.
An empty table gives an empty one at every stage. Columns beyond those of documents are passed on, whatever
their names, up to the last stage, which returns the columns of pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticemill.llm import exact, minhash, mixture, packing, toxicity
from noticemill.llm.ship import ship
from noticemill.session import size_shuffles, written


def _ready(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session with the library's modules sent along, and as many shuffle partitions as the size of
    the documents asks for."""
    size_shuffles(spark, f"{sf_dir}/documents.parquet")
    return ship(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _ready(spark, sf_dir).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark, sf_dir)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark, sf_dir)
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark, sf_dir)
    return mixture.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark, sf_dir)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack),
]

#: The first stage learns a classifier, which SQL cannot; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
