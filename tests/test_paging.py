import pytest
from pyspark.sql import functions as F

from noticemill.operators.paging import check_limit, dashboard_page, deep_page, next_page, page


@pytest.fixture(scope="module")
def listing(spark):
    return spark.range(1000).select(
        F.col("id"),
        F.when(F.col("id") % 10 > 0, (F.col("id") * 7919) % 50).alias("value"),
    )


def order():
    return [F.desc("value"), F.col("id")]


@pytest.fixture(scope="module")
def whole(listing):
    rows = [(r.id, r.value) for r in listing.collect()]
    return [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("skip", [0, 30, 880, 990, 1200])
def test_pages(listing, whole, skip):
    wanted = whole[skip : skip + 25]
    assert ids(page(listing, order(), ["id"], skip, 25)) == wanted
    assert ids(deep_page(listing, order(), ["id"], skip, 25)) == wanted


def test_walk_by_last_row(listing, whole):
    rows = page(listing, order(), ["id"], 0, 100).collect()
    walked = [r.id for r in rows]
    while rows:
        rows = next_page(listing, "value", "id", rows[-1].value, rows[-1].id, 100).collect()
        walked += [r.id for r in rows]
    assert walked == whole


def test_dashboard(listing, whole):
    assert ids(dashboard_page(listing, order(), ["id"], 2)) == whole[50:75]


def test_limits(listing):
    assert check_limit(500) == 500
    for bad in (0, 501):
        with pytest.raises(ValueError):
            check_limit(bad)
    with pytest.raises(ValueError):
        page(listing, order(), ["id"], -1, 5)
