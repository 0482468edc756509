"""The queries of this package by name, each with the SQL it must agree with, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticemill.llm import conversations, exact, filter_audit, language_model, minhash, mixture, packing, personal, quality, secrets, sql, token_counts, toxicity, vectors
from noticemill.llm.ship import ship
from noticemill.session import size_shuffles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with the modules sent along and as many shuffle partitions as its size asks for."""
    path = f"{sf_dir}/{name}.parquet"
    size_shuffles(spark, path)
    return ship(spark).read.parquet(path)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), path)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixture.takings(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(_table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_model": (op1_language_model, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_mixture": (op3_mixture, None),
    "op4_vectors": (op4_vectors, sql.VECTORS),
    "op5_minhash": (op5_minhash, sql.NEAR),
    "op6_personal": (op6_personal, None),
    "op7_quality": (op7_quality, None),
    "op8_packing": (op8_packing, None),
    "op9_exact": (op9_exact, sql.EXACT),
    "op10_toxicity": (op10_toxicity, None),
    "op11_conversations": (op11_conversations, sql.REPAIR),
    "op12_secrets": (op12_secrets, None),
    "op13_filter_audit": (op13_filter_audit, sql.AUDIT),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text is not None}
