"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.check import compare, connect
from workload import queries as workload_queries


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "callback_pct_ytd" in frame.columns


def test_all_queries_have_sql():
    assert set(workload_queries.queries()) <= set(entry.queries()) & set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(workload_queries.queries()))
def test_query_matches_sql(spark, con, name):
    good, note = compare(spark, con, SF_SMALL, name)
    assert good, note
