from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.frames import as_text, dicts, table
from wrenchlight.operators.upsert import latest_per_key, upsert, upsert_table
from wrenchlight.schemas import TABLES, conform


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, p string, v int, note string")


def test_batch_wins_and_unmatched_stay(spark):
    target = frame(spark, [("a", "x", 9, "old"), ("b", "x", 1, "old"), (None, "x", 1, "no key")])
    batch = frame(spark, [("a", "x", 2, None), ("c", "x", 1, "new"), (None, "x", 1, "no key either")])
    found = sorted(map(str, dicts(upsert(target, batch, ["k"], newest=["v"]))))
    wanted = [
        {"k": "a", "p": "x", "v": 2, "note": None},
        {"k": "b", "p": "x", "v": 1, "note": "old"},
        {"k": "c", "p": "x", "v": 1, "note": "new"},
        {"k": None, "p": "x", "v": 1, "note": "no key"},
        {"k": None, "p": "x", "v": 1, "note": "no key either"},
    ]
    assert found == sorted(map(str, wanted))


def test_null_safe_key_takes_null_and_empty_for_the_same(spark):
    target = frame(spark, [("a", None, 1, "old"), ("b", "", 1, "old"), ("c", "x", 1, "old")])
    batch = frame(spark, [("a", "", 2, "new"), ("b", None, 2, "new"), ("c", None, 2, "new")])
    rows = dicts(upsert(target, batch, ["k"], ["p"]))
    assert sorted((r["k"], r["note"]) for r in rows) == [("a", "new"), ("b", "new"), ("c", "new"), ("c", "old")]


def test_batch_is_reduced_to_the_newest_row(spark):
    rows = [("a", "x", 1, "1"), ("a", "x", None, "none"), ("a", "x", 3, "3"), ("a", "x", 2, "2"), ("b", "x", None, "b")]
    found = dicts(latest_per_key(frame(spark, rows), ["k"], newest=["v"]))
    assert sorted((r["k"], r["note"]) for r in found) == [("a", "3"), ("b", "b")]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    ties = [("t", "x", 1, n) for n in "abcdef"]
    first = dicts(latest_per_key(frame(spark, ties), ["k"], newest=["v"]))
    second = dicts(latest_per_key(frame(spark, ties[::-1]).repartition(3), ["k"], newest=["v"]))
    assert first == second


def test_keep_newest(spark):
    target = frame(spark, [("a", "x", 5, "stored"), ("b", "x", 1, "stored"), ("c", "x", None, "stored"), ("d", "x", 2, "stored")])
    batch = frame(spark, [("a", "x", 4, "late"), ("b", "x", 2, "late"), ("c", "x", 1, "late"), ("d", "x", 2, "again")])
    rows = dicts(upsert(target, batch, ["k"], newest=["v"], keep_newest=True))
    assert sorted((r["k"], r["note"]) for r in rows) == [("a", "stored"), ("b", "late"), ("c", "late"), ("d", "again")]


def test_replace_children(spark):
    target = frame(spark, [("p1", "a", 1, "old"), ("p1", "b", 1, "old"), ("p2", "a", 1, "old")])
    batch = frame(spark, [("p1", "a", 2, "new")])
    rows = dicts(upsert(target, batch, ["k", "p"], replace_children_of=["k"]))
    assert sorted((r["k"], r["p"], r["note"]) for r in rows) == [("p1", "a", "new"), ("p2", "a", "old")]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x", "y", None]), st.integers(0, 5)), max_size=8),
    st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None]), st.integers(0, 5)), max_size=8),
)
def test_upsert_twice_is_upsert_once(spark, stored, batch):
    stored = frame(spark, [(k, p, v, "s") for k, p, v in stored])
    target = latest_per_key(stored, ["k"], ["p"], ["v"])
    incoming = frame(spark, [(k, p, v, "i") for k, p, v in batch])
    for options in ({}, {"keep_newest": True}, {"small_batch": True}):
        once = upsert(target, incoming, ["k"], ["p"], ["v"], **options)
        twice = upsert(once, incoming, ["k"], ["p"], ["v"], **options)
        assert as_text(once) == as_text(twice)
        assert once.count() == once.select("k", F.coalesce("p", F.lit(""))).distinct().count()


@pytest.mark.parametrize("name", sorted(TABLES))
def test_every_table_has_a_consistent_spec(spark, name):
    spec = TABLES[name]
    columns = set(spec.schema.fieldNames())
    assert set(spec.full_key) <= columns and set(spec.parent) <= columns
    assert spec.version is None or spec.version in columns
    nothing = spark.createDataFrame([], spec.schema)
    assert upsert_table(spec, nothing, nothing).count() == 0


def test_conform(spark):
    raw = spark.createDataFrame(
        [("j", "1250", "2026-01-01T00:00:00Z", "3", "extra"), ("k", "bad", "bad", "x", "extra")],
        "JOB_ID string, total_amount string, created_at string, num_appointments string, other string",
    )
    first, second = dicts(conform(raw, "jobs").orderBy("job_id"))
    assert first["job_id"] == "j" and first["total_amount"] == 1250 and first["num_appointments"] == 3
    assert first["created_at"].isoformat() == "2026-01-01T00:00:00" and first["company_id"] is None
    assert second["total_amount"] is None and second["created_at"] is None and second["num_appointments"] is None
    typed = table(spark, "jobs", {"job_id": "j"})
    assert conform(typed, "jobs") is typed
