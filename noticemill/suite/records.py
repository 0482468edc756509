"""Parsing, projection and sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions.hashing import content_hash
from noticemill.functions.parsing import (
    first_filled,
    infer_status,
    normalize_vendor_name,
    parse_currency,
    parse_date,
)
from noticemill.operators.classify import train_from_seed
from noticemill.operators.lookup import latest_per_source
from noticemill.operators.quality import reasons
from noticemill.operators.tables import canonical_table, raw_table
from noticemill.plans.curate import process
from noticemill.plans.ingest import as_json, collect
from noticemill.session import scratch_path
from noticemill.sources import city, federal
from noticemill.sources.landing import page_snapshots, read_source
from noticemill.sources.resume import newest_first, take_until_checkpoint
from noticemill.sources.spec import explode_pages, list_sources, pages_to_read, records
from noticemill.suite import views as v

_STAMP = "yyyy-MM-dd HH:mm:ss"


def canonical_projection(spark: SparkSession, sf: str) -> DataFrame:
    return v.canonical(spark, sf).select(
        "record_id", "source_name", "source_id", "source_url", "title", "description", "agency",
        F.date_format("posted_date", _STAMP).alias("posted_date"),
        "estimated_value", "currency", "status", "vendor_name", "vendor_normalized",
        "content_hash",
    )


CANONICAL_PROJECTION = f"""WITH {v.CANONICAL_VIEW}
SELECT record_id, source_name, source_id, source_url, title, description, agency,
  strftime(posted_date, '%Y-%m-%d %H:%M:%S') AS posted_date, estimated_value, currency, status,
  vendor_name, vendor_normalized, content_hash
FROM canonical"""


def vendor_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return v.notices(spark, sf).select(
        "source_id", "vendor", normalize_vendor_name("vendor").alias("vendor_normalized")
    )


VENDOR_NORMALIZE = f"""WITH {v.NOTICES}
SELECT source_id, vendor, {v.VENDOR_SQL} AS vendor_normalized FROM notices"""


def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.date_format(parse_date("posted_date"), _STAMP)
    return v.notices(spark, sf).select("source_id", "posted_date", parsed.alias("parsed"))


DATE_PARSE = f"""WITH {v.NOTICES}
SELECT source_id, posted_date,
  strftime(try_strptime(posted_date, {v.DATE_LIST}), '%Y-%m-%d %H:%M:%S') AS parsed
FROM notices"""


def currency_parse(spark: SparkSession, sf: str) -> DataFrame:
    return v.notices(spark, sf).select(
        "source_id", "amount", parse_currency("amount").alias("value"), F.lit("USD").alias("currency")
    )


CURRENCY_PARSE = f"""WITH {v.NOTICES}
SELECT source_id, amount,
  try_cast(regexp_replace(amount, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value, 'USD' AS currency
FROM notices"""


def status_infer(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_notices(spark, sf).select(
        "source_id", F.col("extracted")["status_text"].alias("status_text"),
        infer_status("extracted").alias("status"),
    )


STATUS_INFER = f"""WITH {v.NOTICES}
SELECT source_id, status_text, {v.STATUS_SQL} AS status
FROM (SELECT *, {v.VALUES_TEXT} AS t FROM notices)"""


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return v.raw_notices(spark, sf).select("source_name", "source_id", "content_hash")


CONTENT_HASHES = f"""WITH {v.NOTICES}
SELECT source_name, source_id, sha256({v.CONTENT_SQL}) AS content_hash FROM notices"""


def quoted_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of whole page texts: quotes, line ends and letters of many languages."""
    pages = v.table(spark, sf, "pages")
    entries = F.create_map(F.lit("url"), "url", F.lit("html"), "html")
    return pages.select("page_id", content_hash(entries).alias("content_hash"))


def _sql_quoted(col: str) -> str:
    body = f"replace({col}, '\\', '\\\\')"
    for char, escaped in ((10, "\\n"), (13, "\\r"), (9, "\\t")):
        body = f"replace({body}, chr({char}), '{escaped}')"
    return (
        f"CASE WHEN contains({col}, '''') AND NOT contains({col}, '\"') THEN '\"' || {body} || '\"'"
        f" ELSE '''' || replace({body}, '''', '\\''') || '''' END"
    )


QUOTED_CONTENT_HASH = f"""
SELECT page_id, sha256('[(''html'', ' || {_sql_quoted("html")} || '), (''url'', ' ||
  {_sql_quoted("url")} || ')]') AS content_hash
FROM pages"""


def falsy_key_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.notices(spark, sf).select("o_orderkey", "vendor", "amount")
    key = first_filled(F.col("vendor"), F.col("amount"))
    return rows.select("o_orderkey", key.alias("source_key")).filter("source_key IS NOT NULL")


FALSY_KEY_FALLBACK = f"""WITH {v.NOTICES}
SELECT o_orderkey, coalesce(nullif(vendor, ''), nullif(amount, '')) AS source_key FROM notices
WHERE coalesce(nullif(vendor, ''), nullif(amount, '')) IS NOT NULL"""

# ── landed rows of the two sources ───────────────────────────────────────


def federal_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One response row per order; some have no link, some no id."""
    orders = v.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    text = key.cast("string")
    values = {
        "noticeId": F.when(key % 11 == 10, "").otherwise(F.concat(F.lit("F-"), text)),
        "uiLink": F.when(key % 3 > 0, F.concat(F.lit("https://example.org/"), text)),
        "title": F.concat(F.lit("Order "), text),
        "department": F.col("o_orderpriority"),
        "subTier": F.col("o_orderstatus"),
        "postedDate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "solicitationNumber": F.col("o_custkey").cast("string"),
    }
    fields = [values.get(f, F.lit(None)).cast("string").alias(f) for f in federal.FIELDS]
    return orders.select(key.alias("place"), F.struct(*fields).alias("row"))


def federal_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Response pages of 25 rows; a group is one page."""
    rows = federal_rows(spark, sf)
    total = rows.agg(F.count("*").alias("n")).scalar()
    offset = F.floor(F.col("place") / federal.PAGE_SIZE) * federal.PAGE_SIZE
    paged = rows.groupBy(offset.alias("offset")).agg(
        F.sort_array(F.collect_list(F.struct("place", "row"))).alias("both")
    )
    return paged.select(
        "offset",
        total.alias("totalRecords"),
        F.transform("both", lambda b: b["row"]).alias("opportunitiesData"),
    )


FEDERAL_RECORDS = """
federal_records AS (
  SELECT o_orderkey AS seq, 'F-' || o_orderkey AS source_id, 'sam_gov' AS source_name,
    CASE WHEN o_orderkey % 3 > 0 THEN 'https://example.org/' || o_orderkey
      ELSE 'https://sam.gov/opp/F-' || o_orderkey || '/view' END AS source_url,
    'Order ' || o_orderkey AS title, o_orderpriority AS agency, o_orderstatus AS sub_tier,
    strftime(o_orderdate, '%Y-%m-%d') AS posted_date,
    o_custkey::VARCHAR AS solicitation_number,
    sha256('[(''agency'', ''' || o_orderpriority || '''), (''naics_code'', ''''), (''office'', ''''), '
      || '(''posted_date'', ''' || strftime(o_orderdate, '%Y-%m-%d') || '''), '
      || '(''response_deadline'', ''''), (''set_aside'', ''''), '
      || '(''solicitation_number'', ''' || o_custkey || '''), (''sub_tier'', ''' || o_orderstatus
      || '''), (''title'', ''Order ' || o_orderkey || '''), (''type'', '''')]') AS content_hash
  FROM orders WHERE o_orderkey % 11 <> 10
)"""


def city_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One response row per customer, in two sections; ids are partly blank."""
    customer = v.table(spark, sf, "customer")
    key = F.col("c_custkey")
    text = key.cast("string")
    section = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), city.SECTION)
    values = {
        "request_id": F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("R-"), text)),
        "pin": F.when(key % 7 > 0, F.concat(F.lit("P-"), text)),
        "short_title": F.col("c_name"),
        "agency_name": F.col("c_mktsegment"),
        "start_date": F.lit("2024-01-01"),
        "section_name": section.otherwise("Hearings"),
    }
    fields = [values.get(f, F.lit(None)).cast("string").alias(f) for f in city.FIELDS]
    return customer.select(key.alias("place"), F.struct(*fields).alias("row"))


def city_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Response pages of 50 rows; a group is one page."""
    offset = F.floor(F.col("place") / city.PAGE_SIZE) * city.PAGE_SIZE
    paged = city_rows(spark, sf).groupBy(offset.alias("page_offset")).agg(
        F.sort_array(F.collect_list(F.struct("place", "row"))).alias("both")
    )
    return paged.select("page_offset", F.transform("both", lambda b: b["row"]).alias("rows"))


CITY_RECORDS = """
city_rows AS (
  SELECT c_custkey AS seq,
    coalesce(CASE WHEN c_custkey % 5 > 0 THEN 'R-' || c_custkey END,
      CASE WHEN c_custkey % 7 > 0 THEN 'P-' || c_custkey END) AS source_id,
    c_name AS title, c_mktsegment AS agency,
    CASE WHEN c_custkey % 7 > 0 THEN 'P-' || c_custkey ELSE '' END AS pin
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
),
city_records AS (
  SELECT seq, source_id, 'nyc_procurement' AS source_name,
    'https://data.cityofnewyork.us/resource/3khw-qi8f/' || source_id AS source_url, title, agency,
    pin,
    sha256('[(''agency'', ''' || agency || '''), (''category'', ''''), (''contact_email'', ''''), '
      || '(''contact_name'', ''''), (''due_date'', ''''), (''notice_type'', ''''), (''pin'', '''
      || pin || '''), (''posted_date'', ''2024-01-01''), (''selection_method'', ''''), '
      || '(''title'', ''' || title || ''')]') AS content_hash
  FROM city_rows WHERE source_id IS NOT NULL
)"""


def federal_records(spark: SparkSession, sf: str, as_of: date | None = None) -> DataFrame:
    pages = pages_to_read(federal.as_pages(federal_pages(spark, sf)))
    return records(federal.FEDERAL, explode_pages(pages), as_of)


def city_records(spark: SparkSession, sf: str) -> DataFrame:
    pages = city_pages(spark, sf).withColumn("total_records", F.lit(None).cast("long"))
    return records(city.CITY, explode_pages(pages_to_read(pages)))


def mapping_project(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.col("extracted")
    return federal_records(spark, sf).select(
        "source_id", "source_url", ext["title"].alias("title"), ext["agency"].alias("agency"),
        ext["sub_tier"].alias("sub_tier"), ext["office"].alias("office"),
        ext["posted_date"].alias("posted_date"),
        ext["solicitation_number"].alias("solicitation_number"),
    )


MAPPING_PROJECT = f"""WITH {FEDERAL_RECORDS}
SELECT source_id, source_url, title, agency, sub_tier, '' AS office, posted_date,
  solicitation_number
FROM federal_records"""


def date_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = federal_records(spark, sf, date.fromisoformat(v.AS_OF))
    return rows.select("source_id", F.col("extracted")["posted_date"].alias("posted_date"))


DATE_WINDOW = f"""WITH {FEDERAL_RECORDS}
SELECT source_id, posted_date FROM federal_records
WHERE posted_date::DATE BETWEEN DATE '{v.AS_OF}' - 30 AND DATE '{v.AS_OF}'"""


def section_filter(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.col("extracted")
    return city_records(spark, sf).select(
        "source_id", "source_url", ext["title"].alias("title"), ext["agency"].alias("agency"),
        ext["pin"].alias("pin"), ext["category"].alias("category"),
    )


SECTION_FILTER = f"""WITH {CITY_RECORDS}
SELECT source_id, source_url, title, agency, pin, '' AS category FROM city_records"""

_RECORD = ("source_name", "source_id", "source_url", "seq", "content_hash")


def page_union(spark: SparkSession, sf: str) -> DataFrame:
    return federal_records(spark, sf).unionByName(city_records(spark, sf)).select(*_RECORD)


PAGE_UNION = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS}
SELECT source_name, source_id, source_url, seq, content_hash FROM federal_records
UNION ALL SELECT source_name, source_id, source_url, seq, content_hash FROM city_records"""


def landed_federal(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as response files and read back through the source."""
    path = scratch_path(spark, "landed-federal")
    federal_pages(spark, sf).write.json(path)
    return read_source(spark, federal.FEDERAL, path).select(*_RECORD)


LANDED_FEDERAL = f"""WITH {FEDERAL_RECORDS}
SELECT source_name, source_id, source_url, seq, content_hash FROM federal_records"""


def landed_city(spark: SparkSession, sf: str) -> DataFrame:
    """One file per response, each a bare array."""
    path = scratch_path(spark, "landed-city")
    pages = city_pages(spark, sf).select("page_offset", F.to_json("rows").alias("value"))
    pages.repartition("page_offset").write.partitionBy("page_offset").text(path)
    return read_source(spark, city.CITY, path).select(*_RECORD)


LANDED_CITY = f"""WITH {CITY_RECORDS}
SELECT source_name, source_id, source_url, seq, content_hash FROM city_records"""


def source_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The registered sources with the number of records each one gave."""
    counts = (
        federal_records(spark, sf)
        .unionByName(city_records(spark, sf))
        .groupBy(F.col("source_name").alias("name"))
        .agg(F.count("*").alias("records"))
    )
    listed = list_sources(spark).select("name", "base_url", "description", "requires_browser")
    return listed.join(counts, "name")


SOURCE_OVERVIEW = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS}
SELECT 'sam_gov' AS name, '{federal.FEDERAL.base_url}' AS base_url,
  '{federal.FEDERAL.description}' AS description, FALSE AS requires_browser, count(*) AS records
FROM federal_records
UNION ALL SELECT 'nyc_procurement', '{city.CITY.base_url}', '{city.CITY.description}', FALSE,
  count(*) FROM city_records"""


def take_until_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read newest first, up to the one stored last."""
    rows = federal_rows(spark, sf).select(
        F.lit("sam_gov").alias("source_name"),
        F.col("row.noticeId").alias("source_id"),
        F.col("place").alias("seq"),
        F.col("row.postedDate").alias("posted_date"),
    )
    stored = rows.filter(F.col("posted_date") < v.AS_OF).withColumn(
        "fetched_at", F.col("posted_date").cast("timestamp")
    )
    order = newest_first(F.col("posted_date"), "seq")
    return take_until_checkpoint(rows, latest_per_source(stored, tie="seq"), order).drop("seq")


TAKE_UNTIL_NEWEST_FIRST = f"""WITH rows AS (
  SELECT CASE WHEN o_orderkey % 11 = 10 THEN '' ELSE 'F-' || o_orderkey END AS source_id,
    o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS posted_date
  FROM orders
),
mark AS (
  SELECT arg_max(source_id, (posted_date, seq)) AS id FROM rows WHERE posted_date < '{v.AS_OF}'
),
cut AS (
  SELECT max(posted_date) AS d FROM rows WHERE source_id = (SELECT id FROM mark)
),
cut_seq AS (
  SELECT min(seq) AS s FROM rows
  WHERE source_id = (SELECT id FROM mark) AND posted_date = (SELECT d FROM cut)
)
SELECT 'sam_gov' AS source_name, source_id, posted_date FROM rows
WHERE posted_date > (SELECT d FROM cut)
  OR (posted_date = (SELECT d FROM cut) AND seq < (SELECT s FROM cut_seq))"""


def _landed(spark: SparkSession, sf: str) -> dict[str, str]:
    """Response files of both sources in a landing folder, those of the city packed."""
    landing = scratch_path(spark, "landing")
    federal_pages(spark, sf).write.json(f"{landing}/sam_gov")
    city_folder = f"{landing}/nyc_procurement"
    city.pack(city_pages(spark, sf).select("page_offset", F.to_json("rows").alias("value")), city_folder)
    return {"sam_gov": f"{landing}/sam_gov", "nyc_procurement": city_folder}


def collect_job(spark: SparkSession, sf: str) -> DataFrame:
    """Both sources collected into a raw table, which is then read."""
    table = raw_table(scratch_path(spark, "raw"))
    collect(spark, table, _landed(spark, sf), 0)
    return table.read(spark).select("source_name", "source_id", "source_url", "content_hash")


COLLECT_JOB = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS}
SELECT source_name, source_id, source_url, content_hash FROM federal_records
UNION ALL SELECT source_name, source_id, source_url, content_hash FROM city_records"""


def collect_again(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of a second run over the same pages, without the checkpoint: all is skipped."""
    table, landed = raw_table(scratch_path(spark, "raw")), _landed(spark, sf)
    collect(spark, table, landed, 0)
    again = collect(spark, table, landed, 10, resume=False)
    return as_json(again.drop("elapsed_s"))


COLLECT_AGAIN = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS}
SELECT '{{"items_collected":0,"items_skipped":' || (
  (SELECT count(*) FROM federal_records) + (SELECT count(*) FROM city_records))
  || ',"failures":0}}' AS summary"""


def _listing(rows: DataFrame, most: int) -> DataFrame:
    """Response pages of a listing, newest (largest) place first, up to the place ``most``."""
    placed = rows.filter(F.col("place") <= most).withColumn("place", F.lit(most) - F.col("place"))
    offset = F.floor(F.col("place") / federal.PAGE_SIZE) * federal.PAGE_SIZE
    paged = placed.groupBy(offset.alias("offset")).agg(
        F.sort_array(F.collect_list(F.struct("place", "row"))).alias("both")
    )
    return paged.select(
        "offset", F.transform("both", lambda b: b["row"]).alias("opportunitiesData")
    )


def collect_two_landings(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over one growing folder: a listing of the older half of the orders, then a longer
    one of all, in which every tenth order has changed. The second run goes up to the record that
    was stored last."""
    rows = federal_rows(spark, sf)
    most = rows.agg(F.max("place")).first()[0]
    landing, table = scratch_path(spark, "landing"), raw_table(scratch_path(spark, "raw"))
    title = F.when(F.col("place") % 10 == 0, F.concat("row.title", F.lit(" again"))).otherwise(
        F.col("row.title")
    )
    changed = rows.withColumn("row", F.col("row").withField("title", title))
    for run, listing in enumerate((_listing(rows, most // 2), _listing(changed, most))):
        listing.write.json(f"{landing}/sam_gov/run={run}")
        collect(spark, table, {"sam_gov": f"{landing}/sam_gov"}, run)
    kept = table.read(spark)
    return kept.select("source_id", F.col("extracted")["title"].alias("title"))


# the record stored last is the one with the smallest key: it ends both listings
COLLECT_TWO_LANDINGS = """
SELECT 'F-' || o_orderkey AS source_id,
  'Order ' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 AND o_orderkey >
    (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 11 <> 10) THEN ' again' ELSE '' END
    AS title
FROM orders WHERE o_orderkey % 11 <> 10"""


def collect_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings that one run reads: of the older half of the orders, with an empty page after the
    second one, and a later one of two thirds of all, with changed titles. Beside the stored records,
    which of them is the checkpoint of the next run."""
    rows = federal_rows(spark, sf)
    most = rows.agg(F.max("place")).first()[0]
    landing, table = scratch_path(spark, "landing"), raw_table(scratch_path(spark, "raw"))
    half = _listing(rows, most // 2)
    none = F.filter("opportunitiesData", lambda _: F.lit(False))
    cut = F.when(F.col("offset") == 2 * federal.PAGE_SIZE, none).otherwise(F.col("opportunitiesData"))
    title = F.concat(F.col("row.title"), F.lit(" again"))
    later = rows.filter(F.col("place") % 3 > 0).withColumn("row", F.col("row").withField("title", title))
    for run, listing in enumerate((half.withColumn("opportunitiesData", cut), _listing(later, most))):
        listing.write.json(f"{landing}/sam_gov/run={run}")
    collect(spark, table, {"sam_gov": f"{landing}/sam_gov"}, 0, until_empty=True)
    kept = table.read(spark)
    marks = latest_per_source(kept).select("source_name", F.col("source_id").alias("mark"))
    return kept.join(F.broadcast(marks), "source_name").select(
        "source_id", F.col("extracted")["title"].alias("title"), (F.col("source_id") == F.col("mark")).alias("checkpoint")
    )


# the later listing ends with the smallest key that it has and that has an id
COLLECT_TWO_RUNS = """
WITH most AS (SELECT max(o_orderkey) AS n FROM orders),
kept AS (
  SELECT o_orderkey, o_orderkey % 3 > 0 AS later FROM orders, most
  WHERE o_orderkey % 11 <> 10
    AND (o_orderkey % 3 > 0 OR (o_orderkey <= n // 2 AND n // 2 - o_orderkey < 50))
)
SELECT 'F-' || o_orderkey AS source_id,
  'Order ' || o_orderkey || CASE WHEN later THEN ' again' ELSE '' END AS title,
  o_orderkey = (SELECT min(o_orderkey) FROM kept WHERE later) AS checkpoint
FROM kept"""


def _broken(spark: SparkSession, sf: str) -> dict[str, str]:
    """A landing folder in which some responses are cut off and some do not say their place."""
    landing = scratch_path(spark, "landing")
    page = F.floor(F.col("offset") / federal.PAGE_SIZE)
    whole = F.to_json(
        F.struct(
            F.when(page % 7 != 1, F.col("offset")).alias("offset"), "totalRecords", "opportunitiesData"
        )
    )
    text = F.when(page % 5 == 0, F.left(whole, F.length(whole) - 9)).otherwise(whole)
    federal_pages(spark, sf).select(text.alias("value")).write.text(f"{landing}/sam_gov")
    rows = F.to_json("rows")
    cut = F.when(
        F.floor(F.col("page_offset") / city.PAGE_SIZE) % 2 == 1, F.left(rows, F.length(rows) - 9)
    ).otherwise(rows)
    pages = city_pages(spark, sf).select("page_offset", cut.alias("value"))
    folder = f"{landing}/nyc_procurement"
    city.pack(pages, folder)
    return {"sam_gov": f"{landing}/sam_gov", "nyc_procurement": folder}


def collect_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What a run over broken responses counts: failed sources, stored records, and unreadable
    pages by reason."""
    table = raw_table(scratch_path(spark, "raw"))
    summary = collect(spark, table, _broken(spark, sf), 0)
    pages = table.read_aside(spark, "unreadable").groupBy("source_name", "reason").agg(
        F.count("*").alias("n")
    )
    stored = table.read(spark).groupBy("source_name").agg(F.count("*").alias("n"))
    return (
        pages.unionByName(stored.withColumn("reason", F.lit("stored")))
        .unionByName(
            summary.select(
                F.lit("").alias("source_name"),
                F.lit("failures").alias("reason"),
                F.col("failures").cast("long").alias("n"),
            )
        )
    )


COLLECT_FAILURES = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS},
federal AS (
  SELECT DISTINCT o_orderkey // 25 AS page FROM orders
),
city_page AS (SELECT DISTINCT c_custkey // 50 AS page FROM customer)
SELECT 'sam_gov' AS source_name, 'not a response' AS reason, count(*) AS n FROM federal
WHERE page % 5 = 0
UNION ALL SELECT 'sam_gov', 'no offset', count(*) FROM federal WHERE page % 5 <> 0 AND page % 7 = 1
UNION ALL SELECT 'nyc_procurement', 'not a response', count(*) FROM city_page WHERE page % 2 = 1
UNION ALL SELECT 'sam_gov', 'stored', count(*) FROM federal_records
WHERE seq // 25 % 5 <> 0 AND seq // 25 % 7 <> 1
UNION ALL SELECT 'nyc_procurement', 'stored', count(*) FROM city_records WHERE seq // 50 % 2 = 0
UNION ALL SELECT '', 'failures', 2"""


def process_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw records, some without a link: what process stores and what it keeps aside."""
    raw = raw_table(scratch_path(spark, "raw"))
    canonical = canonical_table(scratch_path(spark, "canonical"))
    key = F.substring("source_id", 3, 20).cast("long")
    rows = v.raw_notices(spark, sf).withColumn(
        "source_url", F.when(key % 9 > 0, F.col("source_url"))
    )
    raw.write_batch(rows, 0)
    process(spark, raw, canonical, train_from_seed(spark), 0)
    aside = canonical.read_aside(spark, "quarantine")
    stored = canonical.read(spark, columns=("source_id",))
    return stored.select("source_id", F.lit("").alias("reasons")).unionByName(
        aside.select("source_id", F.array_join("reasons", "; ").alias("reasons"))
    )


PROCESS_QUARANTINE = f"""WITH {v.NOTICES}
SELECT source_id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing source_url' ELSE '' END AS reasons
FROM notices"""


def process_job(spark: SparkSession, sf: str) -> DataFrame:
    """The collected records processed into a canonical table, which is then read."""
    raw = raw_table(scratch_path(spark, "raw"))
    canonical = canonical_table(scratch_path(spark, "canonical"))
    collect(spark, raw, _landed(spark, sf), 0)
    process(spark, raw, canonical, train_from_seed(spark), 0)
    return canonical.read(spark).select(
        "record_id", "source_name", "source_id", "title", "agency",
        F.date_format("posted_date", _STAMP).alias("posted_date"), "status", "version",
        "content_hash",
    )


PROCESS_JOB = f"""WITH {FEDERAL_RECORDS}, {CITY_RECORDS},
both_sources AS (
  SELECT source_name, source_id, title, agency, posted_date, content_hash,
    lower(concat_ws(' ', title, agency, sub_tier, posted_date, solicitation_number)) AS t
  FROM federal_records
  UNION ALL SELECT source_name, source_id, title, agency, '2024-01-01', content_hash,
    lower(concat_ws(' ', title, agency, pin)) FROM city_records
)
SELECT sha256(source_name || ':' || source_id) AS record_id, source_name, source_id, title, agency,
  posted_date || ' 00:00:00' AS posted_date, {v.STATUS_SQL} AS status, 1::INTEGER AS version,
  content_hash
FROM both_sources"""


def page_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return page_snapshots(v.table(spark, sf, "pages"), "pages", "error")


PAGE_SNAPSHOT = """
SELECT page_id::VARCHAR AS source_id, 'pages' AS source_name, url AS source_url, html AS raw_html,
  'error_' || substr(string_split(url, '/')[-1], 1, 60) || '.html' AS snapshot_name
FROM pages"""


def validate_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    checked = reasons(v.canonical(spark, sf))
    return checked.select("record_id", F.array_join("reasons", "; ").alias("reasons")).filter(
        "reasons <> ''"
    )


VALIDATE_QUARANTINE = f"""WITH {v.CANONICAL_VIEW}
SELECT record_id, 'unknown category' AS reasons FROM canonical
WHERE category IS NULL OR category = ''"""

QUERIES = {
    "canonical_projection": (canonical_projection, CANONICAL_PROJECTION),
    "vendor_normalize": (vendor_normalize, VENDOR_NORMALIZE),
    "date_parse": (date_parse, DATE_PARSE),
    "currency_parse": (currency_parse, CURRENCY_PARSE),
    "status_infer": (status_infer, STATUS_INFER),
    "content_hash": (content_hashes, CONTENT_HASHES),
    "content_hash_quoted": (quoted_content_hash, QUOTED_CONTENT_HASH),
    "falsy_key_fallback": (falsy_key_fallback, FALSY_KEY_FALLBACK),
    "mapping_project": (mapping_project, MAPPING_PROJECT),
    "date_window": (date_window, DATE_WINDOW),
    "section_filter": (section_filter, SECTION_FILTER),
    "page_union": (page_union, PAGE_UNION),
    "landed_federal": (landed_federal, LANDED_FEDERAL),
    "landed_city": (landed_city, LANDED_CITY),
    "source_overview": (source_overview, SOURCE_OVERVIEW),
    "take_until_newest_first": (take_until_newest_first, TAKE_UNTIL_NEWEST_FIRST),
    "collect_job": (collect_job, COLLECT_JOB),
    "collect_again": (collect_again, COLLECT_AGAIN),
    "collect_two_landings": (collect_two_landings, COLLECT_TWO_LANDINGS),
    "collect_two_runs": (collect_two_runs, COLLECT_TWO_RUNS),
    "collect_failures": (collect_failures, COLLECT_FAILURES),
    "process_job": (process_job, PROCESS_JOB),
    "process_quarantine": (process_quarantine, PROCESS_QUARANTINE),
    "page_snapshot": (page_snapshot, PAGE_SNAPSHOT),
    "validate_quarantine": (validate_quarantine, VALIDATE_QUARANTINE),
}
