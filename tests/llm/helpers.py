"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, odd columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "b", 1),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n ", "en", "a", 4),
    (5, "the quick  brown fox\njumps over the lazy dog", "en", "b", 1),
    (5, "the quick  brown fox\njumps over the lazy dog", "en", "b", 1),
    (6, "Ünïcode   ÉCOLE naïve straße 😀 <|endoftext|> x", "fr", None, 9),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "x" * 40_000, "en", "b", 40_000),
    (9, "one", "en", "c", 3),
    (10, "one two three four five six", "en", "c", 3),
    (None, "a row without an id", "en", "c", 3),
]


def odd_documents(spark: SparkSession) -> DataFrame:
    """The odd rows, with extra columns that clash with names the operators use."""
    rows = [(*r, "x", 1, 2.0) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", hash string, size int, key double")


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
