"""Every registered query against its SQL."""

import pathlib

import pytest

from noticemill.suite import registry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registry.ALL))
def test_query(spark, con, name):
    run, sql = registry.ALL[name]
    verdict = compare(spark, con, SF, run, sql)
    assert verdict.startswith("ok" if sql else "rows only"), verdict


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
