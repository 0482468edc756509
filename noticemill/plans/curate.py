"""Process: raw records into the canonical table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions.hashing import record_id
from noticemill.functions.parsing import (
    infer_status,
    map_first_filled,
    map_text,
    normalize_vendor_name,
    parse_currency,
    parse_date,
)
from noticemill.operators.classify import predict
from noticemill.operators.merge import merge_actions, merge_changes
from noticemill.operators.quality import has_required, split_valid
from noticemill.operators.similarity import THRESHOLD, Duplicates, find_duplicates
from noticemill.operators.tables import RecordTable
from noticemill.schemas import CANONICAL_KEY
from noticemill.session import size_shuffles, written

# The extracted keys each canonical field is read from, first filled one wins.
ALIASES: Mapping[str, Sequence[str]] = {
    "posted_date": ("posted_date", "publish_date"),
    "due_date": ("due_date", "close_date", "deadline"),
    "award_date": ("award_date",),
    "estimated_value": ("estimated_value", "amount", "value"),
    "vendor": ("vendor", "vendor_name", "awardee"),
}
TEXT_KEYS: Mapping[str, str] = {
    "title": "title",
    "description": "description",
    "agency": "agency",
    "contact_info": "contact",
    "location": "location",
}
CURRENCY = "USD"


def to_canonical(
    raw: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    text_keys: Mapping[str, str] = TEXT_KEYS,
    now: Column | None = None,
    word_boundary: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Canonical records from raw ones: one projection, not yet classified.

    ``keep`` names raw columns to carry along, such as an arrival order.
    """
    ext = F.col("extracted")
    now = F.current_timestamp() if now is None else now
    vendor = map_first_filled(ext, aliases["vendor"])

    def text(field: str) -> Column:
        return map_text(ext, text_keys[field]).alias(field)

    def moment(field: str) -> Column:
        return parse_date(map_first_filled(ext, aliases[field])).alias(field)

    return raw.select(
        record_id("source_name", "source_id").alias("record_id"),
        "source_name",
        "source_id",
        "source_url",
        text("title"),
        text("description"),
        text("agency"),
        moment("posted_date"),
        moment("due_date"),
        moment("award_date"),
        parse_currency(map_first_filled(ext, aliases["estimated_value"])).alias("estimated_value"),
        F.lit(CURRENCY).alias("currency"),
        infer_status(ext, word_boundary).alias("status"),
        F.lit("other").alias("category"),
        F.lit(0.0).alias("category_confidence"),
        vendor.alias("vendor_name"),
        normalize_vendor_name(vendor).alias("vendor_normalized"),
        text("contact_info"),
        text("location"),
        F.array().cast("array<string>").alias("tags"),
        "content_hash",
        F.lit(1).alias("version"),
        now.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
        *keep,
    )


def classify_records(canonical: DataFrame, model: PipelineModel) -> DataFrame:
    """Category and confidence from title and description."""
    texts = canonical.withColumn("text", F.concat("title", F.lit(" "), "description"))
    return predict(model, texts).select(*canonical.columns)


def only_new(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw records whose canonical form is missing or out of date."""
    known = stored.select(F.col("record_id").alias("_id"), F.col("content_hash").alias("_hash"))
    same = (record_id("source_name", "source_id") == F.col("_id")) & (
        F.col("content_hash").eqNullSafe(F.col("_hash"))
    )
    return raw.join(known, same, "left_anti")


@dataclass(frozen=True)
class Curated:
    """One curate run over raw records; every part is planned when it is asked for."""

    normal: DataFrame
    stored: DataFrame
    #: needed by ``records`` and ``changes``
    model: PipelineModel | None
    now: Column | None
    threshold: float
    force: bool

    def valid(self) -> DataFrame:
        """Rows to curate. Status, category and confidence come out of this run and are within
        their sets, so the required fields decide."""
        return has_required(self.normal)

    def quarantine(self) -> DataFrame:
        """Rows that fail validation, with their reasons."""
        return split_valid(self.normal)[1]

    def records(self) -> DataFrame:
        """All valid records of the run, classified."""
        return classify_records(self.valid(), self.model)

    def changes(self) -> DataFrame:
        """The canonical rows to write. What is unchanged is skipped by its content hash, so only
        the rows that are written get classified."""
        changed = merge_changes(
            self.valid(), self.stored, CANONICAL_KEY, _ORDER, versioned=True, now=self.now,
            force=self.force, one_row_per_key=True,
        )
        return classify_records(changed, self.model)

    def duplicates(self) -> Duplicates:
        """Near-duplicates among the records; they are reported, never merged."""
        return find_duplicates(self.valid(), "record_id", self.threshold)

    def summary(
        self, upserted: DataFrame | None = None, duplicates: Duplicates | None = None
    ) -> DataFrame:
        """One row: processed, upserted, duplicates_flagged. ``upserted`` may give the one-value
        count of rows already written, ``duplicates`` a search already made."""
        if upserted is None:
            actions = merge_actions(
                self.valid(), self.stored, CANONICAL_KEY, _ORDER, force=self.force,
                one_row_per_key=True,
            )
            upserted = actions.agg(F.coalesce(F.sum("n_writes"), F.lit(0)).alias("n"))
        flagged = (duplicates or self.duplicates()).pair_count()
        return self.valid().agg(F.count("*").alias("processed")).select(
            "processed",
            upserted.scalar().alias("upserted"),
            flagged.scalar().alias("duplicates_flagged"),
        )


# raw keys are unique, so a record has one row and its order does not matter
_ORDER = ("content_hash",)


def curate(
    raw: DataFrame,
    stored: DataFrame,
    model: PipelineModel | None,
    now: Column | None = None,
    threshold: float = THRESHOLD,
    force: bool = False,
) -> Curated:
    """Normalize, classify, look for near-duplicates, and work out what to write."""
    return Curated(to_canonical(raw, now=now), stored, model, now, threshold, force)


def process(
    spark: SparkSession,
    raw: RecordTable,
    canonical: RecordTable,
    model: PipelineModel,
    batch: int,
    now: Column | None = None,
    incremental: bool = False,
    force: bool = False,
) -> DataFrame:
    """Run over the whole raw table and write canonical batch ``batch``; returns the summary.

    Rows that fail validation go to the folder ``quarantine`` of the canonical table with their
    reasons; ``quarantined`` counts them, so it and ``processed`` add up to the rows read.
    ``force`` writes all valid rows, changed or not.
    ``incremental`` looks only at raw records that are new or changed. Near-duplicates are looked
    for in the table as it is after the write, where every record of the raw table has its text.
    """
    size_shuffles(spark, raw.path, canonical.path)
    canonical.compact_after(spark, before=batch)
    stored = canonical.read(spark, batch, ("content_hash", "version", "created_at"))
    rows = raw.read(spark)
    if incremental:
        rows = only_new(rows, stored)
    done = curate(rows, stored, model, now, force=force)
    # the projection is evaluated once; writing, quarantine and summary read its table
    done = replace(done, normal=written(done.normal, "normal"))
    canonical.write_batch(done.changes(), batch)
    quarantined = canonical.write_aside(done.quarantine(), "quarantine", batch)
    upserted = canonical.read_batch(spark, batch).agg(F.count("*").alias("n"))
    texts = canonical.read(spark, columns=("title", "description"))
    summary = done.summary(upserted, find_duplicates(texts, "record_id"))
    return summary.withColumn("quarantined", F.lit(quarantined).cast("long"))
