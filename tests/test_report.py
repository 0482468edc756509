import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticemill.operators import report
from noticemill.operators.lookup import count, find, get_raw, latest_per_source


@pytest.fixture(scope="module")
def canonical(spark):
    rows = [
        ("1", "a", "supplies", "open", "Red (new) chairs", "", "City", dt.datetime(2024, 1, 2)),
        ("2", "a", "", "open", "Blue chairs", "RED paint", "City", None),
        ("3", "b", None, "", "Road", "bridge", "reduction office", dt.datetime(2024, 1, 3)),
        ("4", "b", "supplies", None, "Desk", None, None, dt.datetime(2024, 1, 2)),
    ]
    return spark.createDataFrame(
        rows,
        "record_id string, source_name string, category string, status string, title string,"
        " description string, agency string, posted_date timestamp",
    )


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("a", "1", dt.datetime(2024, 1, 1, 23)),
        ("a", "2", dt.datetime(2024, 1, 2, 1)),
        ("b", "1", dt.datetime(2024, 1, 2, 2)),
    ]
    return spark.createDataFrame(rows, "source_name string, source_id string, fetched_at timestamp")


def rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return [r.record_id for r in df.collect()]


def test_blank_labels_are_one_group(canonical):
    assert rows(report.by_category(canonical)) == [("supplies", 2), ("uncategorized", 2)]
    assert rows(report.by_status(canonical)) == [("open", 2), ("unknown", 2)]


def test_timeline(raw):
    assert rows(report.timeline(raw)) == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert rows(report.timeline(raw, days=1)) == [("2024-01-01", 1)]
    assert rows(report.timeline(raw, days=1, latest=True)) == [("2024-01-02", 2)]


def test_stats_in_one_frame(raw, canonical):
    got = {(r.metric, r.label): r["count"] for r in report.stats(raw, canonical).collect()}
    assert got == {
        ("raw_count", None): 3, ("source", "a"): 2, ("source", "b"): 1,
        ("day", "2024-01-01"): 1, ("day", "2024-01-02"): 2,
        ("canonical_count", None): 4, ("category", "supplies"): 2,
        ("category", "uncategorized"): 2, ("status", "open"): 2, ("status", "unknown"): 2,
    }
    limited = report.raw_stats(raw, days=1).collect()
    assert [r.label for r in limited if r.metric == "day"] == ["2024-01-01"]


def test_search(canonical):
    assert sorted(ids(report.filtered(canonical, term="red"))) == ["1", "2", "3"]
    assert ids(report.filtered(canonical, term="(new)", regex=False)) == ["1"]
    assert sorted(ids(report.filtered(canonical, term="chairs$"))) == ["1", "2"]


def test_blank_filters_do_not_filter(canonical):
    assert report.filtered(canonical, source="", category=None, status="").count() == 4
    assert ids(report.filtered(canonical, source="a", category="supplies", status="open")) == ["1"]


def test_listing(canonical):
    listing = report.list_canonical(canonical, limit=3)
    assert listing.total.first().total == 4
    assert ids(listing.records) == ["3", "1", "4"]
    assert ids(report.list_canonical(canonical, limit=3, skip=3).records) == ["2"]
    with pytest.raises(ValueError):
        report.list_canonical(canonical, limit=501)


def test_shares_and_pages(canonical):
    shares = report.with_share(report.by_category(canonical))
    assert [r.percent for r in shares.collect()] == [50.0, 50.0]
    assert rows(report.page_count(canonical, 3)) == [(4, 2)]


def test_lookups(raw, canonical):
    assert rows(get_raw(raw, "b", "1").select("source_id")) == [("1",)]
    assert get_raw(raw, "b", "9").count() == 0
    assert sorted(rows(latest_per_source(raw))) == [("a", "2"), ("b", "1")]
    assert ids(find(canonical, F.col("title").contains("chairs"), limit=1, skip=1)) == ["2"]
    assert count(canonical).first()["count"] == 4
