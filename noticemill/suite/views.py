"""The given tables seen as notices, documents, event records and pages.

Every view is written twice: as a DataFrame and, under the same name, as SQL text that goes
in front of the checking query. Remainders of keys only choose between the forms a value can take
(date formats, blank fields, suffixes); every row of every table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions.hashing import content_hash, record_id
from noticemill.operators.merge import merge_changes
from noticemill.plans.curate import to_canonical
from noticemill.schemas import CANONICAL_KEY
from noticemill.session import spread, written

SPLIT = "2024-01-16 00:00:00"  # events before are stored, the others arrive
NOW = "2024-02-01 00:00:00"
AS_OF = "1998-09-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ── notices: orders with their customer ──────────────────────────────────

_DATE_FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("MM-dd-yyyy", "%m-%d-%Y"),
    ("MMMM d, yyyy", "%B %-d, %Y"),
    ("MMM d, yyyy", "%b %-d, %Y"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a source would give them, all text."""
    orders = spread(table(spark, sf_dir, "orders")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("timestamp")
    )
    customer = table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    forms = F.array(*[F.lit(form) for form, _ in _DATE_FORMS])
    written = F.call_function("date_format", F.col("o_orderdate"), F.get(forms, key % 8))
    posted = F.coalesce(written, F.lit("not a date"))
    price = F.format_number("o_totalprice", 2)
    amount = (
        F.when(key % 4 == 0, F.concat(F.lit("$"), price))
        .when(key % 4 == 1, price)
        .when(key % 4 == 2, "TBD")
        .otherwise("")
    )
    vendor = (
        F.when(key % 3 == 0, F.concat("c_name", F.lit(", Inc.")))
        .when(key % 3 == 1, F.concat("c_name", F.lit(" LLC")))
        .otherwise("")
    )
    status = (
        F.when(F.col("o_orderstatus") == "O", "Active")
        .when(F.col("o_orderstatus") == "F", "Closed")
        .when(key % 2 == 0, "Award Notice")
        .otherwise("Pending")
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        "o_orderdate",
        F.when(key % 2 == 0, "src_a").otherwise("src_b").alias("source_name"),
        F.concat(F.lit("N-"), key.cast("string")).alias("source_id"),
        F.concat(F.lit("https://example.org/"), key.cast("string")).alias("source_url"),
        F.concat_ws(" ", F.lit("Notice"), key.cast("string"), "c_mktsegment").alias("title"),
        F.col("c_mktsegment").alias("agency"),
        posted.alias("posted_date"),
        amount.alias("amount"),
        vendor.alias("vendor"),
        status.alias("status_text"),
    )


_SQL_POSTED = " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{sql}')" for i, (_, sql) in enumerate(_DATE_FORMS)
)
NOTICES = f"""
notices AS (
  SELECT o_orderkey, o_orderdate,
    CASE WHEN o_orderkey % 2 = 0 THEN 'src_a' ELSE 'src_b' END AS source_name,
    'N-' || o_orderkey AS source_id,
    'https://example.org/' || o_orderkey AS source_url,
    'Notice ' || o_orderkey || ' ' || c_mktsegment AS title,
    c_mktsegment AS agency,
    CASE o_orderkey % 8 {_SQL_POSTED} ELSE 'not a date' END AS posted_date,
    CASE o_orderkey % 4 WHEN 0 THEN '$' || format('{{:,.2f}}', o_totalprice)
      WHEN 1 THEN format('{{:,.2f}}', o_totalprice) WHEN 2 THEN 'TBD' ELSE '' END AS amount,
    CASE o_orderkey % 3 WHEN 0 THEN c_name || ', Inc.' WHEN 1 THEN c_name || ' LLC' ELSE '' END
      AS vendor,
    CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed'
      WHEN o_orderkey % 2 = 0 THEN 'Award Notice' ELSE 'Pending' END AS status_text
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

# ── canonical: the notices after normalization ───────────────────────────

_FIELDS = ("title", "agency", "posted_date", "amount", "vendor", "status_text")


def raw_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = []
    for field in _FIELDS:
        entries += [F.lit(field), F.col(field)]
    return (
        notices(spark, sf_dir)
        .select(
            "source_id",
            "source_name",
            "source_url",
            F.col("o_orderdate").alias("fetched_at"),
            F.lit(None).cast("string").alias("raw_html"),
            F.create_map(*entries).alias("extracted"),
            content_hash({field: F.col(field) for field in _FIELDS}).alias("content_hash"),
            "agency",
            "o_orderkey",
        )
    )


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical notices; the category follows the customer's segment and is blank for one."""
    rows = to_canonical(
        raw_notices(spark, sf_dir), now=F.lit(NOW).cast("timestamp"), keep=("o_orderkey",)
    )
    agency = F.col("agency")
    category = (
        F.when(agency == "BUILDING", "construction")
        .when(agency == "MACHINERY", "maintenance")
        .when(agency == "AUTOMOBILE", "transportation")
        .when(agency == "HOUSEHOLD", "supplies")
        .when(F.col("o_orderkey") % 2 == 0, "")
    )
    return rows.withColumn("category", category)


DATE_LIST = "[" + ", ".join(f"'{sql.replace('%-d', '%d')}'" for _, sql in _DATE_FORMS) + "]"
SUFFIX = r"\b(inc|llc|ltd|corp|corporation|company|co|group|holdings|plc|lp|llp)\b\.?"
VENDOR_SQL = (
    f"nullif(lower(trim(regexp_replace(regexp_replace(vendor, '{SUFFIX}', '', 'gi'),"
    r" '\s+', ' ', 'g'))), '')"
)
STATUS_SQL = """CASE WHEN t LIKE '%award%' THEN 'awarded'
      WHEN t LIKE '%closed%' OR t LIKE '%expired%' OR t LIKE '%past due%' THEN 'closed'
      WHEN t LIKE '%cancelled%' OR t LIKE '%canceled%' THEN 'cancelled'
      WHEN t LIKE '%open%' OR t LIKE '%active%' OR t LIKE '%accepting%' THEN 'open'
      ELSE 'unknown' END"""
VALUES_TEXT = "lower(concat_ws(' ', title, agency, posted_date, amount, vendor, status_text))"
CONTENT_SQL = (
    "'[(''agency'', ''' || agency || '''), (''amount'', ''' || amount ||"
    " '''), (''posted_date'', ''' || posted_date || '''), (''status_text'', ''' || status_text ||"
    " '''), (''title'', ''' || title || '''), (''vendor'', ''' || vendor || ''')]'"
)
CANONICAL_VIEW = f"""{NOTICES},
canonical AS (
  SELECT o_orderkey, sha256(source_name || ':' || source_id) AS record_id, source_name, source_id,
    source_url, title, '' AS description, agency,
    try_strptime(posted_date, {DATE_LIST}) AS posted_date,
    try_cast(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS estimated_value,
    'USD' AS currency, {STATUS_SQL} AS status,
    CASE agency WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'maintenance'
      WHEN 'AUTOMOBILE' THEN 'transportation' WHEN 'HOUSEHOLD' THEN 'supplies'
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN '' END END AS category,
    nullif(vendor, '') AS vendor_name, {VENDOR_SQL} AS vendor_normalized,
    sha256({CONTENT_SQL}) AS content_hash
  FROM (SELECT *, {VALUES_TEXT} AS t FROM notices)
)"""

# ── documents as records ─────────────────────────────────────────────────


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the title ``Document <language>`` and the whole text as description."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("source_name"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("Document "), F.col("lang")).alias("title"),
        F.col("text").alias("description"),
    )


DOCUMENT_RECORDS = """
document_records AS (
  SELECT doc_id, source AS source_name, doc_id::VARCHAR AS source_id,
    'Document ' || lang AS title, text AS description
  FROM documents
)"""

# ── event records ────────────────────────────────────────────────────────


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated fetches of the notice (event_type, user_id)."""
    value = F.floor(F.col("value") / 10).cast("long").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_name"),
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("source_id"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.col("event_id").alias("seq"),
        F.sha2(value, 256).alias("content_hash"),
        record_id(F.col("event_type"), F.concat(F.lit("U-"), F.col("user_id").cast("string"))).alias(
            "record_id"
        ),
    )


EVENT_RECORDS = """
event_records AS (
  SELECT event_type AS source_name, 'U-' || user_id AS source_id, ts AS fetched_at,
    event_id AS seq, sha256(floor(value / 10)::BIGINT::VARCHAR) AS content_hash,
    sha256(event_type || ':U-' || user_id) AS record_id
  FROM events
)"""


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as the events before the split left it: the last write of each key."""
    early = event_records(spark, sf_dir).filter(F.col("fetched_at") < F.lit(SPLIT).cast("timestamp"))
    empty = spark.createDataFrame([], "record_id string, content_hash string, version int")
    changes = merge_changes(
        early, empty, CANONICAL_KEY, ("fetched_at", "seq"), versioned=True,
        now=F.lit(NOW).cast("timestamp"),
    )
    return written(changes, "stored-events")


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark, sf_dir).filter(
        F.col("fetched_at") >= F.lit(SPLIT).cast("timestamp")
    )


# One row per event: is it a write, given the hash before it in its key?
EVENT_WRITES = f"""{EVENT_RECORDS},
event_writes AS (
  SELECT *, fetched_at < TIMESTAMP '{SPLIT}' AS early,
    content_hash IS DISTINCT FROM lag(content_hash) OVER key_order AS is_write
  FROM event_records
  WINDOW key_order AS (PARTITION BY source_name, source_id ORDER BY fetched_at, seq)
)"""

# ── tokens and weights ───────────────────────────────────────────────────


def values_list(words) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)
