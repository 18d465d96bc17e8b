"""What keeps loads within disk and time: compressed pages, scratch data that goes, records looked at once."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_landing import JOB, land
from tests.test_warehouse import AT
from wrenchlight.sources import warehouse
from wrenchlight.sources.load import load_all
from wrenchlight.sources.warehouse import Warehouse
from wrenchlight.streaming import changes
from workload import ingestion


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(path, f)) for path, _, files in os.walk(folder) for f in files)


def test_pages_land_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingestion, "PAGES_PER_FILE", 200)
    pages = ingestion.job_pages(spark, SF_SMALL)
    ingestion._land(pages, str(tmp_path), "jobs")
    landed = spark.read.text(str(tmp_path / "jobs"))
    texts = sorted(r.page for r in pages.collect())
    assert sorted(r.value for r in landed.collect()) == texts
    assert bytes_below(tmp_path) < sum(map(len, texts)) / 4
    assert {r["count"] <= 200 for r in landed.groupBy("_metadata.file_name").count().collect()} == {True}


def test_a_load_leaves_no_scratch_data(spark, tmp_path, monkeypatch):
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(warehouse, "shared_folder", lambda spark, purpose: f"{scratch}/{purpose}-{uuid.uuid4().hex}")
    land(tmp_path / "landing", "jobs", {"jobs": [{**JOB, "id": "j1"}]})
    assert load_all(spark, str(tmp_path / "landing"), str(tmp_path / "w"), AT, backfill=True)
    assert scratch.exists() and os.listdir(scratch) == []


class KeptState:
    """A group's state as the function under test sees it."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_one_call_settles_all_keys_of_a_group():
    state = KeptState()

    def run(*frames):
        made = [pd.DataFrame(f, columns=["key", "version", "arrived", "digest", "record"]) for f in frames]
        return {tuple(r) for out in changes._newest((0,), iter(made), state) for r in out.itertuples(index=False)}

    assert run([("a", "1", "x", "A", "ra"), ("b", "", "x", "B", "rb")], [("a", "2", "w", "A2", "ra2")]) == {("a", "2", "w", "ra2"), ("b", "", "x", "rb")}
    # Sent again with a later arrival, and an older version; then another text, and a new key.
    assert run([("b", "", "y", "B", "rb"), ("a", "1", "z", "A", "ra")]) == set()
    assert run([("b", "", "y", "B3", "late")], [("b", "", "z", "B4", "rb4"), ("c", None, None, "C", "rc")]) == {("b", "", "z", "rb4"), ("c", "", "", "rc")}
    assert dict(zip(state.get[0], zip(*state.get[1:]))) == {"a": ("2", "w", "A2"), "b": ("", "z", "B4"), "c": ("", "", "C")}


def test_records_sent_again_rewrite_nothing(spark, tmp_path):
    """A second load of the same files leaves all files of a table; other words under the same arrival still get in."""
    root = Warehouse(spark, str(tmp_path))
    rows = spark.range(300).selectExpr("concat('j', id % 90) AS job_id", "concat('a', id) AS appointment_id", "CASE WHEN id % 3 = 0 THEN 'e' END AS dispatched_employee_id", "1 AS arrival_window_minutes", "'a' AS _arrived")

    def files():
        return {r[0] for r in spark.read.parquet(root.path("job_appointments")).select("_metadata.file_path").distinct().collect()}

    assert root.upsert("job_appointments", rows.unionAll(rows)) == 300
    before = files()
    assert root.upsert("job_appointments", rows.repartition(3)) == 0 and files() == before
    changed = rows.withColumn("arrival_window_minutes", F.expr("CASE WHEN appointment_id IN ('a7', 'a9') THEN 2 ELSE 1 END"))
    older = rows.withColumn("arrival_window_minutes", F.lit(3)).withColumn("_arrived", F.lit("0"))
    new = spark.createDataFrame([("j0", "a300", "b"), ("j0", "a300", "c")], "job_id string, appointment_id string, _arrived string")
    assert root.upsert("job_appointments", changed.unionAll(older).unionByName(new, allowMissingColumns=True)) == 3 and files() != before
    found = root.tables()["job_appointments"].groupBy("arrival_window_minutes").count().collect()
    assert {tuple(r) for r in found} == {(1, 298), (2, 2), (None, 1)}
