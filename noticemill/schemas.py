"""Raw and canonical record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The allowed categories and statuses.
CATEGORIES = (
    "construction",
    "it_services",
    "professional_services",
    "supplies",
    "consulting",
    "healthcare",
    "transportation",
    "maintenance",
    "other",
)
STATUSES = ("open", "closed", "awarded", "cancelled", "unknown")

RAW = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("source_url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("raw_html", T.StringType()),
        T.StructField("extracted", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hash", T.StringType()),
    ]
)
RAW_KEY = ("source_name", "source_id")

CANONICAL = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("agency", T.StringType()),
        T.StructField("posted_date", T.TimestampType()),
        T.StructField("due_date", T.TimestampType()),
        T.StructField("award_date", T.TimestampType()),
        T.StructField("estimated_value", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("category_confidence", T.DoubleType()),
        T.StructField("vendor_name", T.StringType()),
        T.StructField("vendor_normalized", T.StringType()),
        T.StructField("contact_info", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
CANONICAL_KEY = ("record_id",)
