"""TF-IDF weights as a table of (id, term, weight).

The text is shuffled once, by document; counting terms, joining the vocabulary and normalizing
then stay in that partitioning. Only pre-aggregated term counts are shuffled besides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticemill.functions.stopwords import ENGLISH
from noticemill.functions.text import tokens
from noticemill.operators.joins import BROADCAST_ROWS, broadcast_if
from noticemill.session import text_partitions

DEDUP_TERMS = 10_000
CLASSIFIER_TERMS = 5_000


def postings(documents: DataFrame, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """(id, term, tf) from (id, text); ids are unique."""
    # a task's words grow with its texts, so the number of tasks has to follow the input
    placed = documents.select("id", "text").repartition(text_partitions(documents), "id")
    words = placed.select("id", F.explode(tokens("text")).alias("term"))
    if stop_words:
        words = words.filter(~F.col("term").isin(*stop_words))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences and documents per term."""
    return posted.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def vocabulary(posted: DataFrame, max_terms: int = DEDUP_TERMS) -> DataFrame:
    """The most frequent terms, (term, cf, df, rank): rank 0 is in the most documents."""
    top = term_stats(posted).orderBy(F.desc("cf"), "term").limit(max_terms)
    # the window sees at most max_terms rows
    by_df = Window.orderBy(F.desc("df"), F.col("term"))
    return top.withColumn("rank", F.row_number().over(by_df) - 1)


def scaled(
    documents: DataFrame,
    max_terms: int = DEDUP_TERMS,
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """(id, term, rank, tf, x): x = tf × (ln((1+n)/(1+df)) + 1), not yet normalized."""
    posted = postings(documents, stop_words)
    n = documents.agg(F.count("*").alias("n")).scalar()
    idf = F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1
    terms = vocabulary(posted, max_terms).select("term", "rank", idf.alias("idf"))
    small = max_terms <= BROADCAST_ROWS
    return posted.join(broadcast_if(small, terms), "term").select(
        "id", "term", "rank", "tf", (F.col("tf") * F.col("idf")).alias("x")
    )


def weights(
    documents: DataFrame,
    max_terms: int = DEDUP_TERMS,
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """(id, term, rank, tf, weight) with each document's vector of length 1.

    A document without a vocabulary term has no rows.
    """
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    rows = scaled(documents, max_terms, stop_words)
    return rows.select("id", "term", "rank", "tf", (F.col("x") / length).alias("weight"))
