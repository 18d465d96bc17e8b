"""Loads in batch and as a stream, from JSON files to tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.frames import as_text, dicts, one
from tests.test_landing import JOB, land
from wrenchlight.plans.context import Context
from wrenchlight.plans.freshness import freshness, load_facts
from wrenchlight.sources.landing import PagesMissing
from wrenchlight.sources.load import load_all
from wrenchlight.operators.joins import spread_join
from wrenchlight.schemas import TABLES, conform
from wrenchlight.sources.tables import Tables
from wrenchlight.sources.warehouse import Warehouse, bucket_of
from wrenchlight.streaming.feed import start_feed

AT = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)


def job(number, **changes):
    return {**JOB, "id": f"j{number}", "updated_at": "2026-02-20T00:00:00Z", **changes}


def test_load_all(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "warehouse")
    land(tmp_path / "landing", "jobs", {"jobs": [job(1), job(2, updated_at="2025-01-01T00:00:00Z")]})
    land(tmp_path / "landing", "job_details", {"id": "j1", "schedule": {"appointments": [{"id": "a"}]}})
    land(tmp_path / "landing", "employees", {"employees": [{"id": "e1", "first_name": "Ann"}]})
    assert load_all(spark, landing, root, AT, backfill=True)
    tables = Warehouse(spark, root).tables()
    assert {r["job_id"] for r in dicts(tables["jobs"])} == {"j1", "j2"}
    # The number of appointments is counted from their table, nowhere stored.
    completed = Context(tables, AT).completed_visits
    assert {r["job_id"]: r["num_appointments"] for r in dicts(completed)} == {"j1": 1, "j2": 0}
    assert tables["job_employees"].count() == 4 and tables["invoices"].count() == 0
    assert tables["employees"].count() == 1 and tables["job_appointments"].count() == 1

    # Too early for the next load, unless forced.
    assert not load_all(spark, landing, root, AT + timedelta(minutes=59))
    before = as_text(tables["jobs"])
    assert load_all(spark, landing, root, AT + timedelta(minutes=59), min_interval=timedelta(0))
    assert as_text(Warehouse(spark, root).tables()["jobs"]) == before

    # An incremental load takes what changed within the window; the incoming row wins.
    land(tmp_path / "landing", "jobs", {"jobs": [
        job(2, work_status="late", updated_at="2025-02-01T00:00:00Z"), job(3, tags=None, updated_at="2026-03-01T00:00:00Z"),
    ]})
    assert load_all(spark, landing, root, AT + timedelta(hours=2))
    now = {r["job_id"]: r for r in dicts(Warehouse(spark, root).tables()["jobs"])}
    assert set(now) == {"j1", "j2", "j3"} and now["j2"]["work_status"] == "complete rated"
    ctx = Context(Warehouse(spark, root).tables(), AT + timedelta(hours=2, minutes=30))
    assert one(freshness(ctx)) == {
        "can_refresh": False,
        "next_refresh": "Mar 01, 2026 09:00 AM CST",
        "last_refresh_display": "Mar 01, 2026 08:00 AM CST",
    }
    facts = {r["key"]: r["value"] for r in dicts(load_facts(ctx))}
    assert facts["last_window_start"] == (AT + timedelta(hours=2) - timedelta(days=60)).isoformat()


def test_children_dropped_upstream(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "warehouse")
    land(tmp_path / "landing", "jobs", {"jobs": [job(1)]})
    load_all(spark, landing, root, AT)
    one_left = Warehouse(spark, root)
    crew = one_left.tables()["job_employees"].filter("employee_id = 'e1'")
    crew = spark.createDataFrame(crew.collect(), crew.schema)
    for replace, left in ((False, 2), (True, 1)):
        one_left.upsert("job_employees", crew, replace)
        assert one_left.tables()["job_employees"].count() == left


def options(spark, *rows):
    return spark.createDataFrame(rows, "option_id string, estimate_id string, name string, _arrived string")


def test_options_that_are_gone_leave_their_buckets(spark, tmp_path):
    """Options are in buckets of their own key; those dropped upstream go wherever they are, also the last of a bucket."""
    warehouse = Warehouse(spark, str(tmp_path), bucket_bytes=200)
    rows = [(f"o{n}", f"e{n % 4}", "old", "a") for n in range(40)] + [(None, "e0", "nameless", "a"), (None, "e1", "nameless", "a")]
    warehouse.upsert("estimate_options", options(spark, *rows).repartition(4))
    assert warehouse.tables()["estimate_options"].count() == 42
    warehouse.upsert("estimate_options", options(spark, ("o0", "e0", "new", "b")), replace_children=True)
    left = {(r["option_id"], r["estimate_id"], r["name"]) for r in dicts(warehouse.tables()["estimate_options"])}
    assert left == {("o0", "e0", "new"), (None, "e1", "nameless")} | {(f"o{n}", f"e{n % 4}", "old") for n in range(40) if n % 4}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"), bucket_bytes=250)
    rows = spark.range(1000).selectExpr("concat('i', id) AS invoice_id", "'open' AS status", "timestamp'2020-01-01' + make_dt_interval(cast((id * 37) % 1000 AS int)) AS invoice_date", "'a' AS _arrived")
    path = str(tmp_path / "given")
    rows.write.parquet(path)
    warehouse.upsert("invoices", spark.read.parquet(path))
    buckets = warehouse.buckets("invoices")
    assert buckets >= 16

    def files():
        found = spark.read.parquet(warehouse.path("invoices")).selectExpr("key_bucket", "_metadata.file_path AS f").distinct().collect()
        return {(r[0], r[1]) for r in found}

    before = files()
    for n in range(2):
        batch = spark.range(5).selectExpr("concat('i', id) AS invoice_id", f"'paid{n}' AS status", f"'b{n}' AS _arrived")
        assert warehouse.upsert("invoices", batch) == 5
        rows = {r["invoice_id"]: r["status"] for r in dicts(warehouse.tables()["invoices"])}
        assert len(rows) == 1000 and rows["i4"] == f"paid{n}" and rows["i5"] == "open"
    now = files()
    changed = {b for b, _ in before ^ now}
    own = {r[0] for r in conform(batch, "invoices").select(bucket_of(TABLES["invoices"], buckets)).distinct().collect()}
    assert changed == own and len(own) <= 5 and {b for b, _ in now} == {b for b, _ in before}
    assert warehouse.upsert("invoices", batch.filter("false")) == 0 and files() == now
    # An older record changes nothing; the number of buckets stays whatever the size of later batches.
    warehouse.upsert("invoices", spark.read.parquet(path).withColumn("status", F.lit("late")).withColumn("_arrived", F.lit("0")))
    assert {r["status"] for r in dicts(warehouse.tables()["invoices"])} == {"open", "paid1"} and warehouse.buckets("invoices") == buckets


def test_rows_of_a_key_and_of_a_parent_share_a_bucket(spark):
    rows = spark.range(500).selectExpr("concat('j', id % 50) AS job_id", "concat('a', id) AS appointment_id", "CASE WHEN id % 3 = 0 THEN '' END AS dispatched_employee_id")
    found = rows.withColumn("b", bucket_of(TABLES["job_appointments"], 16)).groupBy("job_id").agg(F.count_distinct("b").alias("n"))
    assert {r["n"] for r in found.collect()} == {1}
    nameless = options(spark, *[(None, f"e{n % 20}", f"n{n}", "a") for n in range(200)])
    found = nameless.withColumn("b", bucket_of(TABLES["estimate_options"], 16)).groupBy("estimate_id").agg(F.count_distinct("b").alias("n"))
    assert {r["n"] for r in found.collect()} == {1}


def test_frequent_parents_are_noted_with_the_table(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"), bucket_bytes=8000)
    crews = spark.range(6000).selectExpr("CASE WHEN id < 2000 THEN 'hot' ELSE concat('e', id) END AS estimate_id", "concat('p', id) AS employee_id", "'a' AS _arrived")
    crews.write.parquet(str(tmp_path / "given"))
    warehouse.upsert("estimate_employees", spark.read.parquet(str(tmp_path / "given")))
    assert warehouse.buckets("estimate_employees") > 1
    assert [r["hot_key"] for r in dicts(warehouse.tables().hot_parents("estimate_employees"))] == ["hot"]
    more = spark.range(3000).selectExpr("'warm' AS estimate_id", "concat('q', id) AS employee_id", "'b' AS _arrived")
    warehouse.upsert("estimate_employees", more)
    assert {r["hot_key"] for r in dicts(warehouse.tables().hot_parents("estimate_employees"))} == {"hot", "warm"}
    assert warehouse.tables().hot_parents("jobs") is None
    plan = spread_join(warehouse.tables()["estimate_employees"], crews.select("estimate_id").distinct(), "estimate_id", hot=warehouse.tables().hot_parents("estimate_employees"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("estimate_employees") <= 1


def test_columns_added_later_read_as_null(spark, tmp_path):
    spark.createDataFrame([("i1", 5)], "invoice_id string, amount bigint").write.parquet(str(tmp_path / "invoices"))
    row = one(Tables.in_folder(spark, str(tmp_path))["invoices"])
    assert row["amount"] == 5 and row["subtotal"] is None
    assert not Tables.in_folder(spark, str(tmp_path)).exists("jobs")
    with pytest.raises(KeyError):
        Tables.in_folder(spark, str(tmp_path))["no_such_table"]


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    pages = [
        {"jobs": [job(1, work_status="newest", updated_at="2026-02-25T00:00:00Z"), job(2)]},
        {"jobs": [job(1, work_status="older"), job(3, assigned_employees=[])]},
        {"jobs": [job(2, work_status="newest", updated_at="2026-02-26T00:00:00Z")]},
    ]

    def run():
        feed = start_feed(spark, str(landing), str(tmp_path / "streamed"), "jobs", str(tmp_path / "checkpoint"), 1)
        feed.awaitTermination()
        return Warehouse(spark, str(tmp_path / "streamed"))

    land(landing, "jobs", *pages[:2])
    run()
    land(landing, "jobs", pages[2])
    streamed = run().tables()
    load_all(spark, str(landing), str(tmp_path / "loaded"), AT, backfill=True)
    loaded = Warehouse(spark, str(tmp_path / "loaded")).tables()
    assert as_text(streamed["jobs"]) == as_text(loaded["jobs"])
    assert {r["work_status"] for r in dicts(streamed["jobs"])} == {"newest", "complete rated"}
    assert as_text(streamed["job_employees"]) == as_text(loaded["job_employees"])
    # Nothing new: nothing happens.
    before = as_text(streamed["jobs"])
    assert as_text(run().tables()["jobs"]) == before


def test_only_changes_are_written(spark, tmp_path, monkeypatch):
    """Records sent again leave the tables' files alone; newer ones, late older ones and nameless ones are told apart."""
    landing, root, batches = tmp_path / "landing", str(tmp_path / "w"), []
    written = Warehouse.upsert
    monkeypatch.setattr(Warehouse, "upsert", lambda self, name, rows, *more: batches.append((name, written(self, name, rows, *more))) or batches[-1][1])

    def run(*found):
        batches.clear()
        for page in found:
            land(landing, "customers", {"customers": page})
        start_feed(spark, str(landing), root, "customers", str(tmp_path / "checkpoint"), 10, only_changes=True).awaitTermination()
        return sum(n for _, n in batches)

    person = lambda key, name, day="2026-02-01": {"id": key, "first_name": name, "updated_at": f"{day}T00:00:00Z"}
    assert run([person("a", "Ann"), person("b", "Bob")], [person("a", "Ann")]) == 2
    assert run([person("a", "Ann"), person("b", "Bob")]) == 0
    assert run([person("a", "Anna", "2026-02-02")], [person("b", "Old", "2026-01-01")], [{"first_name": "Nobody"}]) == 2
    assert {(r["customer_id"], r["first_name"]) for r in dicts(Warehouse(spark, root).tables()["customers"])} == {("a", "Anna"), ("b", "Bob"), (None, "Nobody")}


def test_a_load_asks_for_all_pages(spark, tmp_path):
    landing = tmp_path / "landing"
    page = lambda n, total, k: {"jobs": [job(k)], "page": n, "total_pages": total}
    day(landing, "2026-02-20", jobs=page(1, 3, 1))
    day(landing, "2026-02-20", jobs=page(3, 3, 3))
    day(landing, "2026-02-21", jobs=page(1, 1, 4))
    with pytest.raises(PagesMissing, match="'page': 2"):
        load_all(spark, str(landing), str(tmp_path / "w"), AT, all_pages=True)
    assert not Warehouse(spark, str(tmp_path / "w")).tables().exists("jobs")
    day(landing, "2026-02-20", jobs=page(2, 3, 2))
    assert load_all(spark, str(landing), str(tmp_path / "w"), AT, all_pages=True)
    assert Warehouse(spark, str(tmp_path / "w")).tables()["jobs"].count() == 4


def day(landing, name, **pages):
    for entity, found in pages.items():
        land(landing, f"{entity}/load_date={name}", found)


def test_a_record_sent_again_wins_whatever_the_files_are_called(spark, tmp_path):
    """Tables without a time of change: the day of arrival decides, also where the newer file has the smaller name or was written first."""
    landing, root = tmp_path / "landing", str(tmp_path / "warehouse")
    for name, status, role, last in (("2026-02-02", "paid", "lead", "Newer"), ("2026-02-01", "open", "tech", "Older")):
        day(
            landing, name,
            invoices={"invoices": [{"id": f"i{k}", "status": status, "items": [{"id": "l", "name": last}]} for k in range(12)]},
            employees={"employees": [{"id": f"e{k}", "role": role} for k in range(12)]},
            estimates={"estimates": [{"id": "s", "created_at": "2026-01-05T00:00:00Z", "assigned_employees": [{"id": "e1"}], "options": [{"id": "o", "name": last}]}]},
            pricebook_materials={"data": [{"uuid": "m", "name": last}]},
        )
    assert load_all(spark, str(landing), root, AT)
    tables = Warehouse(spark, root).tables()
    assert {r["status"] for r in dicts(tables["invoices"])} == {"paid"} and tables["invoices"].count() == 12
    assert {r["role"] for r in dicts(tables["employees"])} == {"lead"} and tables["employees"].count() == 12
    assert {r["name"] for t in ("invoice_items", "estimate_options", "pricebook_materials") for r in dicts(tables[t])} == {"Newer"}
    # An older file that lands late changes nothing.
    before = {t: as_text(tables[t]) for t in ("invoices", "employees", "estimate_options")}
    tables = None
    day(landing, "2026-01-31", invoices={"invoices": [{"id": "i1", "status": "draft"}]}, employees={"employees": [{"id": "e1", "role": "helper"}]})
    assert load_all(spark, str(landing), root, AT + timedelta(hours=2))
    assert {t: as_text(Warehouse(spark, root).tables()[t]) for t in before} == before


def test_items_without_a_time_of_change_are_loaded(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "warehouse")
    land(landing, "customers", {"customers": [{"id": "c1", "updated_at": "2020-01-01T00:00:00Z"}, {"id": "c2"}, {"id": "c3", "updated_at": "soon"}]})
    assert load_all(spark, str(landing), root, AT)
    assert {r["customer_id"] for r in dicts(Warehouse(spark, root).tables()["customers"])} == {"c2", "c3"}


def test_rows_without_a_key_do_not_grow(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "warehouse")
    crew = [{"first_name": "Ann"}, {"first_name": "Bob"}, {"id": "e1"}]
    land(landing, "jobs", {"jobs": [job(1, assigned_employees=crew), job(2, assigned_employees=crew[:1])]})
    land(landing, "customers", {"customers": [{"first_name": "Nobody"}, {"id": "c1"}]})
    for n in range(3):
        assert load_all(spark, str(landing), root, AT + timedelta(hours=2 * n))
        tables = Warehouse(spark, root).tables()
        assert tables["job_employees"].count() == 4 and tables["customers"].count() == 2
    # The job comes again with another nameless helper: the old ones make way.
    land(landing, "jobs", {"jobs": [job(1, assigned_employees=[{"first_name": "Cy"}, {"id": "e1"}])]})
    assert load_all(spark, str(landing), root, AT + timedelta(hours=8))
    rows = dicts(Warehouse(spark, root).tables()["job_employees"])
    assert sorted((r["job_id"], str(r["employee_id"]), str(r["first_name"])) for r in rows) == [("j1", "None", "Cy"), ("j1", "e1", "None"), ("j2", "None", "Ann")]


def test_details_of_the_batch_only(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "warehouse")
    land(landing, "jobs", {"jobs": [job(1), job(2, work_status="scheduled")]})
    land(landing, "job_details", *[{"id": f"j{n}", "schedule": {"appointments": [{"id": "a"}]}} for n in (1, 2, 3)])
    assert load_all(spark, str(landing), root, AT, wanted_details_only=True)
    assert [r["job_id"] for r in dicts(Warehouse(spark, root).tables()["job_appointments"])] == ["j1"]


def test_details_of_earlier_days_are_not_listed(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "warehouse")
    day(landing, "2025-01-01", job_details={"id": "old", "schedule": {"appointments": [{"id": "a"}]}})
    day(landing, "2026-02-20", job_details={"id": "new", "schedule": {"appointments": [{"id": "a"}]}})
    assert load_all(spark, str(landing), root, AT)
    assert [r["job_id"] for r in dicts(Warehouse(spark, root).tables()["job_appointments"])] == ["new"]
