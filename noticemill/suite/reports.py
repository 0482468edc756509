"""Counts, shares, timelines, pages and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions import display
from noticemill.operators import report
from noticemill.operators.paging import dashboard_page, deep_page, next_page
from noticemill.schemas import CANONICAL_KEY
from noticemill.session import written
from noticemill.suite import views as v

_STAMP = "yyyy-MM-dd HH:mm:ss"


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.table_counts(v.event_records(spark, sf), v.canonical(spark, sf))


TABLE_COUNTS = f"""WITH {v.CANONICAL_VIEW}
SELECT (SELECT count(*) FROM events) AS raw_count,
  (SELECT count(*) FROM canonical) AS canonical_count"""

_CATEGORY = "coalesce(nullif(category, ''), 'uncategorized')"


def by_category(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_category(v.canonical(spark, sf))


BY_CATEGORY = f"""WITH {v.CANONICAL_VIEW}
SELECT {_CATEGORY} AS category, count(*) AS count FROM canonical GROUP BY 1 ORDER BY 2 DESC, 1"""


def by_status(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_status(v.canonical(spark, sf))


BY_STATUS = f"""WITH {v.CANONICAL_VIEW}
SELECT coalesce(nullif(status, ''), 'unknown') AS status, count(*) AS count FROM canonical
GROUP BY 1 ORDER BY 2 DESC, 1"""


def by_source(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_source(v.event_records(spark, sf))


BY_SOURCE = """SELECT event_type AS source, count(*) AS count FROM events
GROUP BY 1 ORDER BY 2 DESC, 1"""


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return report.source_list(v.document_records(spark, sf))


SOURCE_LIST = """SELECT source AS name, count(*) AS count FROM documents
GROUP BY 1 ORDER BY 2 DESC, 1"""


def timeline_daily(spark: SparkSession, sf: str) -> DataFrame:
    return report.timeline(v.event_records(spark, sf))


TIMELINE_DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS count FROM events
GROUP BY 1 ORDER BY 1 LIMIT 90"""


def _order_days(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "orders").select(F.col("o_orderdate").alias("fetched_at"))


def timeline_oldest(spark: SparkSession, sf: str) -> DataFrame:
    return report.timeline(_order_days(spark, sf))


TIMELINE_OLDEST = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS count
FROM orders GROUP BY 1 ORDER BY 1 LIMIT 90"""


def timeline_latest(spark: SparkSession, sf: str) -> DataFrame:
    return report.timeline(_order_days(spark, sf), latest=True)


TIMELINE_LATEST = """SELECT date, count FROM (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS count
  FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 90) ORDER BY date"""


def stats_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return report.stats(v.event_records(spark, sf), v.canonical(spark, sf))


STATS_GROUPING_SETS = f"""WITH {v.CANONICAL_VIEW}
SELECT 'raw_count' AS metric, NULL AS label, count(*) AS count FROM events
UNION ALL SELECT 'source', event_type, count(*) FROM events GROUP BY event_type
UNION ALL (SELECT 'day', strftime(ts, '%Y-%m-%d') AS d, count(*) FROM events GROUP BY d
  ORDER BY d LIMIT 90)
UNION ALL SELECT 'canonical_count', NULL, count(*) FROM canonical
UNION ALL SELECT 'category', {_CATEGORY}, count(*) FROM canonical GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM canonical GROUP BY 2"""


def category_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.with_share(report.by_category(v.canonical(spark, sf)))


CATEGORY_SHARE = f"""WITH {v.CANONICAL_VIEW}
SELECT category, count, round(count / sum(count) OVER () * 100, 0) AS percent FROM (
  SELECT {_CATEGORY} AS category, count(*) AS count FROM canonical GROUP BY 1)"""


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.distinct_counts(v.event_records(spark, sf), v.canonical(spark, sf))


DISTINCT_COUNTS = f"""WITH {v.CANONICAL_VIEW}
SELECT (SELECT count(DISTINCT event_type) FROM events) AS n_sources,
  (SELECT count(DISTINCT {_CATEGORY}) FROM canonical) AS n_categories,
  (SELECT string_agg(s, ', ' ORDER BY n DESC, s)
   FROM (SELECT event_type AS s, count(*) AS n FROM events GROUP BY s)) AS source_names"""


def page_count(spark: SparkSession, sf: str) -> DataFrame:
    return report.page_count(report.filtered(v.canonical(spark, sf), status="open"))


PAGE_COUNT = f"""WITH {v.CANONICAL_VIEW}
SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages FROM canonical
WHERE status = 'open'"""


def raw_page(spark: SparkSession, sf: str) -> DataFrame:
    raw = v.raw_notices(spark, sf)
    rows = report.list_raw(raw, source="src_a", limit=50, skip=100).records
    return rows.select(
        "source_name", "source_id", F.date_format("fetched_at", _STAMP).alias("fetched_at")
    )


RAW_PAGE = f"""WITH {v.NOTICES}
SELECT source_name, source_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS fetched_at
FROM notices WHERE source_name = 'src_a'
ORDER BY o_orderdate DESC, source_name, source_id LIMIT 50 OFFSET 100"""


def raw_total(spark: SparkSession, sf: str) -> DataFrame:
    return report.list_raw(v.raw_notices(spark, sf), source="src_a").total


RAW_TOTAL = f"""WITH {v.NOTICES}
SELECT count(*) AS total FROM notices WHERE source_name = 'src_a'"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "record_id", "title", F.date_format("posted_date", _STAMP).alias("posted_date"), "status"
    )


_SHOWN = "record_id, title, strftime(posted_date, '%Y-%m-%d %H:%M:%S') AS posted_date, status"


def canonical_page(spark: SparkSession, sf: str) -> DataFrame:
    listing = report.list_canonical(
        v.canonical(spark, sf), source="src_a", category="construction", status="open", limit=100
    )
    return _shown(listing.records)


CANONICAL_PAGE = f"""WITH {v.CANONICAL_VIEW}
SELECT {_SHOWN} FROM canonical
WHERE source_name = 'src_a' AND category = 'construction' AND status = 'open'
ORDER BY posted_date DESC NULLS LAST, record_id LIMIT 100"""


def dashboard_pages(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("posted_date"), F.col("record_id")]
    return _shown(dashboard_page(v.canonical(spark, sf), order, CANONICAL_KEY, 3))


DASHBOARD_PAGES = f"""WITH {v.CANONICAL_VIEW}
SELECT {_SHOWN} FROM canonical
ORDER BY posted_date DESC NULLS LAST, record_id LIMIT 25 OFFSET 75"""


def far_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page from the far end, by distributed ranks."""
    order = [F.desc("posted_date"), F.col("record_id")]
    rows = written(v.canonical(spark, sf), "canonical")
    return _shown(deep_page(rows, order, CANONICAL_KEY, 1400, 50))


FAR_PAGE = f"""WITH {v.CANONICAL_VIEW}
SELECT {_SHOWN} FROM canonical
ORDER BY posted_date DESC NULLS LAST, record_id LIMIT 50 OFFSET 1400"""


def page_after_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.canonical(spark, sf)
    last = F.lit("1996-01-01 00:00:00").cast("timestamp")
    return _shown(next_page(rows, "posted_date", "record_id", last, "8"))


PAGE_AFTER_ROW = f"""WITH {v.CANONICAL_VIEW}
SELECT {_SHOWN} FROM canonical
WHERE posted_date < TIMESTAMP '1996-01-01' OR posted_date IS NULL
  OR (posted_date = TIMESTAMP '1996-01-01' AND record_id > '8')
ORDER BY posted_date DESC NULLS LAST, record_id LIMIT 25"""


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.document_records(spark, sf).withColumn("agency", F.lit(""))
    return report.filtered(rows, term="the[a-z]+ou").select("doc_id", "source_name", "title")


TEXT_SEARCH = f"""WITH {v.DOCUMENT_RECORDS}
SELECT doc_id, source_name, title FROM document_records
WHERE regexp_matches(title, 'the[a-z]+ou', 'i') OR regexp_matches(description, 'the[a-z]+ou', 'i')"""


def text_search_accents(spark: SparkSession, sf: str) -> DataFrame:
    """A term with an accent finds both cases of it."""
    rows = v.document_records(spark, sf).withColumn("agency", F.lit(""))
    return report.filtered(rows, term="ÈMENT", regex=False).select("doc_id", "source_name")


TEXT_SEARCH_ACCENTS = f"""WITH {v.DOCUMENT_RECORDS}
SELECT doc_id, source_name FROM document_records WHERE contains(lower(description), 'èment')"""


def display_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.display_rows(v.canonical(spark, sf))


DISPLAY_REPORT = f"""WITH {v.CANONICAL_VIEW}
SELECT record_id, title, agency,
  coalesce(strftime(posted_date, '%b %-d, %Y'), '—') AS posted, '—' AS due,
  CASE WHEN estimated_value IS NULL OR estimated_value = 0 THEN '—'
    ELSE '$' || regexp_replace(format('{{:,.3f}}', estimated_value), '\\.?0+$', '') END AS value,
  status
FROM canonical"""


def display_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chart labels: day on the axis, grouped count."""
    days = report.timeline(v.event_records(spark, sf))
    return days.select(
        display.axis_day("date").alias("axis"), display.grouped("count").alias("count_text")
    )


DISPLAY_COUNTS = """SELECT strftime(ts, '%m-%d') AS axis, format('{:,}', count(*)) AS count_text
FROM events GROUP BY strftime(ts, '%Y-%m-%d'), 1 ORDER BY strftime(ts, '%Y-%m-%d') LIMIT 90"""

QUERIES = {
    "table_counts": (table_counts, TABLE_COUNTS),
    "by_category": (by_category, BY_CATEGORY),
    "by_status": (by_status, BY_STATUS),
    "by_source": (by_source, BY_SOURCE),
    "source_list": (source_list, SOURCE_LIST),
    "timeline_daily": (timeline_daily, TIMELINE_DAILY),
    "timeline_oldest": (timeline_oldest, TIMELINE_OLDEST),
    "timeline_latest": (timeline_latest, TIMELINE_LATEST),
    "stats_grouping_sets": (stats_grouping_sets, STATS_GROUPING_SETS),
    "category_share": (category_share, CATEGORY_SHARE),
    "distinct_counts": (distinct_counts, DISTINCT_COUNTS),
    "page_count": (page_count, PAGE_COUNT),
    "raw_page": (raw_page, RAW_PAGE),
    "raw_total": (raw_total, RAW_TOTAL),
    "canonical_page": (canonical_page, CANONICAL_PAGE),
    "dashboard_page": (dashboard_pages, DASHBOARD_PAGES),
    "far_page": (far_page, FAR_PAGE),
    "page_after_row": (page_after_row, PAGE_AFTER_ROW),
    "text_search": (text_search, TEXT_SEARCH),
    "text_search_accents": (text_search_accents, TEXT_SEARCH_ACCENTS),
    "display_report": (display_report, DISPLAY_REPORT),
    "display_counts": (display_counts, DISPLAY_COUNTS),
}
