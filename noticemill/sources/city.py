"""City solicitations: a page is a bare array of rows, newest start date first.

A response does not say its place. It lands as a file of its own in a folder ``page_offset=<n>``, or, as
files by the hundred thousand take longer to list and open than to read, packed with others: below the folder
``packed`` each line is an object with ``page_offset`` and ``response``, the response as a text. Both may
lie below ``run=<n>``, packed ones as ``packed/run=<n>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.functions.parsing import first_filled
from noticemill.sources.spec import PACKED, SourceSpec, landed, register_source, with_landed

# Response fields, extracted keys and their order, section, address, page size.
FIELDS = (
    "request_id", "pin", "short_title", "agency_name", "category_description",
    "type_of_notice_description", "selection_method_description", "due_date", "start_date",
    "contact_name", "email", "section_name",
)
MAPPING = {
    "title": "short_title",
    "agency": "agency_name",
    "category": "category_description",
    "notice_type": "type_of_notice_description",
    "selection_method": "selection_method_description",
    "pin": "pin",
    "due_date": "due_date",
    "posted_date": "start_date",
    "contact_name": "contact_name",
    "contact_email": "email",
}
SECTION = "Procurement"
URL_PREFIX = "https://data.cityofnewyork.us/resource/3khw-qi8f/"
PAGE_SIZE = 50

ROW = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
UNREAD = "_corrupt_record"
PACKED_LINE = f"page_offset long, response string, {UNREAD} string"


def as_pages(files: DataFrame) -> DataFrame:
    """A response that is no array of rows, or without a place, is a page with a problem."""
    rows = F.from_json("value", T.ArrayType(ROW))
    # the parser makes nulls of what it cannot read, and a whole response that is cut off is null
    bad = rows.isNull() | ~F.trim("value").endswith("]")
    unread = F.col(UNREAD) if UNREAD in files.columns else F.lit(None).cast("string")
    bad = unread.isNotNull() | bad
    problem = F.when(F.coalesce(bad, F.lit(True)), "not a response").when(
        F.col("page_offset").isNull(), "no offset"
    )
    return with_landed(
        files,
        F.col("page_offset").cast("long").alias("page_offset"),
        F.lit(None).cast("long").alias("total_records"),
        F.coalesce(rows, F.array().cast(T.ArrayType(ROW))).alias("rows"),
        problem.alias("problem"),
        F.coalesce(unread, F.col("value")).alias("response"),
    )


def pack(pages: DataFrame, folder: str) -> None:
    """Land responses (page_offset, value) in packed files."""
    pages.select("page_offset", F.col("value").alias("response")).write.json(f"{folder}/{PACKED}")


def _filled(spark: SparkSession, *patterns: str) -> list[str]:
    """Those of the patterns that match anything."""
    found = []
    for pattern in patterns:
        place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if len(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or ()):
            found.append(pattern)
    return found


def _single(spark: SparkSession, path: str) -> list[str]:
    """What to read for the responses with a file of their own, where there are packed ones beside them."""
    return _filled(spark, f"{path}/page_offset=*", f"{path}/run=*")


def _unpacked(lines: DataFrame) -> DataFrame:
    return as_pages(lines.select("page_offset", F.col("response").alias("value"), UNREAD, landed()))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one response, in a folder ``page_offset=<n>`` that names its place, or, below
    ``packed``, each line is one."""
    files = spark.read.option("wholetext", True)
    if not _filled(spark, f"{path}/{PACKED}"):
        return as_pages(files.text(path).select("*", landed()))
    packed = _unpacked(spark.read.schema(PACKED_LINE).json(f"{path}/{PACKED}"))
    single = _single(spark, path)
    if not single:
        return packed
    return as_pages(files.option("basePath", path).text(single).select("*", landed())).unionByName(packed)


def stream_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A stream reads one of the two forms."""
    files = spark.readStream.options(**options)
    if not _filled(spark, f"{path}/{PACKED}"):
        return as_pages(files.option("wholetext", True).text(path).select("*", landed()))
    if _single(spark, path):
        raise ValueError(f"{path} has packed responses and others: a stream reads one of the two")
    return _unpacked(files.schema(PACKED_LINE).json(f"{path}/{PACKED}"))


CITY = register_source(
    SourceSpec(
        name="nyc_procurement",
        base_url="https://data.cityofnewyork.us",
        description="Open bids and solicitations of New York agencies",
        tags=("city", "nyc", "us"),
        row_type=ROW,
        read_pages=read_pages,
        stream_pages=stream_pages,
        key=lambda: first_filled(F.col("request_id"), F.col("pin")),
        url=lambda: F.concat(F.lit(URL_PREFIX), F.col("source_id")),
        mapping=MAPPING,
        page_size=PAGE_SIZE,
        keep=lambda: F.col("section_name") == SECTION,
        one_run=True,
    )
)
