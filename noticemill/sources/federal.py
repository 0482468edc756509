"""Federal opportunities: pages are objects with the rows and the announced total."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.functions.parsing import parse_date
from noticemill.sources.spec import SourceSpec, landed, register_source, with_landed

# Response fields, extracted keys and their order, address form, page size, days.
FIELDS = (
    "noticeId", "uiLink", "title", "department", "subTier", "office", "postedDate",
    "responseDeadLine", "type", "typeOfSetAsideDescription", "naicsCode", "solicitationNumber",
)
MAPPING = {
    "title": "title",
    "agency": "department",
    "sub_tier": "subTier",
    "office": "office",
    "posted_date": "postedDate",
    "response_deadline": "responseDeadLine",
    "type": "type",
    "set_aside": "typeOfSetAsideDescription",
    "naics_code": "naicsCode",
    "solicitation_number": "solicitationNumber",
}
URL_FORM = "https://sam.gov/opp/%s/view"
PAGE_SIZE = 25
WINDOW_DAYS = 30

ROW = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
ENVELOPE = T.StructType(
    [
        T.StructField("offset", T.LongType()),
        T.StructField("totalRecords", T.LongType()),
        T.StructField("opportunitiesData", T.ArrayType(ROW)),
    ]
)
UNREAD = "_corrupt_record"


def as_pages(responses: DataFrame) -> DataFrame:
    """A response that is no JSON, or does not say its place, is a page with a problem."""
    unread = F.col(UNREAD) if UNREAD in responses.columns else F.lit(None).cast("string")
    problem = F.when(unread.isNotNull(), "not a response").when(
        F.col("offset").isNull(), "no offset"
    )
    return with_landed(
        responses,
        F.col("offset").alias("page_offset"),
        F.col("totalRecords").alias("total_records"),
        F.coalesce("opportunitiesData", F.array().cast(T.ArrayType(ROW))).alias("rows"),
        problem.alias("problem"),
        F.coalesce(unread, F.to_json(F.struct("offset", "totalRecords", "opportunitiesData"))).alias(
            "response"
        ),
    )


_WITH_UNREAD = T.StructType([*ENVELOPE.fields, T.StructField(UNREAD, T.StringType())])


def read_whole_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one JSON response, over any number of lines."""
    files = spark.read.schema(_WITH_UNREAD).option("multiLine", True).json(path)
    return as_pages(files.select("*", landed()))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON response per line, so that a landed file splits."""
    return as_pages(spark.read.schema(_WITH_UNREAD).json(path).select("*", landed()))


def stream_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    responses = spark.readStream.options(**options).schema(_WITH_UNREAD).json(path)
    return as_pages(responses.select("*", landed()))


def posted_window(as_of: date) -> Column:
    """Posted in the trailing days up to and including ``as_of``."""
    end = F.lit(as_of)
    return F.to_date(parse_date("postedDate")).between(F.date_sub(end, WINDOW_DAYS), end)


FEDERAL = register_source(
    SourceSpec(
        name="sam_gov",
        base_url="https://api.sam.gov",
        description="Contract notices of United States agencies",
        tags=("federal", "us"),
        row_type=ROW,
        read_pages=read_pages,
        stream_pages=stream_pages,
        key=lambda: F.col("noticeId"),
        url=lambda: F.coalesce("uiLink", F.format_string(URL_FORM, "source_id")),
        mapping=MAPPING,
        page_size=PAGE_SIZE,
        window=posted_window,
    )
)
