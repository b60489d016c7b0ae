"""Every registered query with SQL gives the same rows as that SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert 0 < entry.entry(spark).count() <= 25


# Their settings (groups with both labels, fold sizes) need more rows than the smallest tables hold.
NEEDS_MORE_ROWS = {"l2_group_split", "l3_group_split_fallback", "l4_inner_split", "l8_split_report"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - NEEDS_MORE_ROWS))
def test_query_equals_sql(spark, con, folder, name):
    result, _ = compare(spark, con, name, folder)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(NEEDS_MORE_ROWS))
def test_query_equals_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    result, _ = compare(spark, connect(larger), name, larger)
    assert result.startswith("ok"), result
