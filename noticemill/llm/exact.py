"""Exact duplicates: texts that are equal once white space is deleted.

Texts are grouped by a 128-bit hash of the normalised text together with its bytes, so a collision
of the hash never joins two texts there. Each task first reduces its own rows, so however many copies a
text has, a task sends it once per length of the original; what is left of a group then meets as
narrow rows, in which SHA-256 beside the hash stands for the bytes compared. Of a group, the row with the most code points in its original text stays, then the
smallest id.

Null text counts as empty, and all empty texts form one group. A null id never stays while the
group has another of that length; if it has none, it stays itself. Rows that repeat an id and its
text share one answer in ``exact_groups``; ``drop_copies`` leaves one of them. Other columns are
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import SPACES, whole_text
from noticemill.session import written


def _normal(text_column: str):
    return F.translate(whole_text(text_column), SPACES, "")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row."""
    rows = docs.select(
        F.col(id_column).alias("id"),
        _normal(text_column).alias("normal"),
        F.char_length(whole_text(text_column)).alias("size"),
    ).withColumn("hash", F.md5("normal"))
    alike = rows.groupBy("hash", "normal", "size").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    # bytes were compared above; from here on a second digest stands for them in narrow rows
    parts = alike.select("hash", F.sha2("normal", 256).alias("sha"), "size", "n", "id")
    groups = parts.groupBy("hash", "sha").agg(
        F.sum("n").alias("group_size"),
        F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), "id")).alias("best"),
    )
    # as a table of its own, so that both sides of the join are plain shuffles, which AQE splits at hot groups
    groups = written(groups, "groups")
    keyed = rows.select("id", "hash", F.sha2("normal", 256).alias("sha"))
    return keyed.join(groups, ["hash", "sha"]).select(
        F.col("id").alias(id_column),
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    normal = _normal(text_column)
    order = F.struct(
        (-F.char_length(whole_text(text_column))).alias("size"),
        F.col(id_column).isNull().alias("no_id"),
        F.col(id_column).alias("id"),
    )
    best = docs.groupBy(F.md5(normal).alias("_hash"), normal.alias("_normal")).agg(
        F.min_by(F.struct(*[docs[c] for c in docs.columns]), order).alias("_row")
    )
    return best.select("_row.*")
