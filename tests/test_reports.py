from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.frames import dicts
from wrenchlight.operators.reports import integer_shares, lookup_for_few, newest_rows, row_counts


def rounded(raw):
    """Largest remainder by hand: cut, then deal out what is missing."""
    cut = [int(v) for v in raw]
    missing = 100 - sum(cut)
    order = sorted(range(len(raw)), key=lambda i: (-(raw[i] - cut[i]), i))
    for step in range(abs(missing)):
        cut[order[step % len(raw)]] += 1 if missing > 0 else -1
    return cut


def shares(spark, raw):
    frame = spark.createDataFrame(list(enumerate(raw)), "i int, raw double")
    return [r["share"] for r in dicts(integer_shares(frame, "raw", "share", "i").orderBy("i"))]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ([100.0], [100]),
        ([100 / 3] * 3, [34, 33, 33]),
        ([0.0, 0.0, 0.0], [34, 33, 33]),
        ([50.5, 49.5], [51, 49]),
        ([120.5, -20.5], [120, -20]),
        ([110.2, 20.2, -30.4], [110, 20, -30]),
        ([0.0], [100]),
    ],
)
def test_integer_shares(spark, raw, expected):
    assert rounded(raw) == expected
    assert shares(spark, raw) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=0, max_value=10_000), min_size=1, max_size=8))
def test_integer_shares_add_up(spark, weights):
    total = sum(weights)
    raw = [w / total * 100 if total else 0.0 for w in weights]
    found = shares(spark, raw)
    assert sum(found) == 100
    assert found == rounded(raw)


def test_newest_rows_puts_nulls_last(spark):
    frame = spark.createDataFrame([(1, None), (2, "b"), (3, "c"), (4, "a")], "i int, at string")
    assert [r["i"] for r in dicts(newest_rows(frame, "at", 10))] == [3, 2, 4, 1]
    assert [r["i"] for r in dicts(newest_rows(frame, "at", 2))] == [3, 2]


def test_row_counts_of_empty_tables(spark):
    frames = {"a": spark.range(3), "b": spark.range(0)}
    assert dicts(row_counts(frames).orderBy("table_name")) == [
        {"table_name": "a", "row_count": 3},
        {"table_name": "b", "row_count": 0},
    ]


def test_lookup_for_few_is_a_left_join(spark):
    few = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x")], "i int, k string")
    big = spark.createDataFrame([("x", "X", None), ("z", "Z", 1), (None, "N", 2)], "k string, name string, n int")
    found = lookup_for_few(few, big, "k", ("name", "n"))
    wanted = few.join(big, "k", "left").select("i", "k", "name", "n")
    assert sorted(map(str, dicts(found.select("i", "k", "name", "n")))) == sorted(map(str, dicts(wanted)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_lookup_for_few_without_matches(spark):
    few = spark.createDataFrame([(1, "x")], "i int, k string")
    big = spark.createDataFrame([], "k string, name string")
    assert dicts(lookup_for_few(few, big, "k", ("name",)).select("i", "name")) == [{"i": 1, "name": None}]
    nothing = few.filter(F.lit(False))
    assert dicts(lookup_for_few(nothing, big, "k", ("name",))) == []
