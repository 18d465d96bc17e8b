"""Pages read from JSON files and flattened."""

from __future__ import annotations

import json

import pytest

from tests.frames import dicts, table
from wrenchlight.functions.times import instant
from wrenchlight.operators import flatten
from wrenchlight.schemas import schema_listing
from wrenchlight.sources.landing import missing_pages, page_envelope, page_items, read_items, read_pages, updated_within


def land(folder, entity, *pages):
    target = folder / entity
    target.mkdir(parents=True, exist_ok=True)
    start = len(list(target.iterdir()))
    for number, page in enumerate(pages, start):
        (target / f"page{number}.json").write_text(json.dumps(page, indent=1))
    return str(folder)


JOB = {
    "id": "j1",
    "invoice_number": 17,
    "description": "Fix",
    "customer": {"id": "c1"},
    "work_status": "complete rated",
    "total_amount": 12345,
    "tags": ["Residential", "Install"],
    "created_at": "2026-01-02T03:04:05Z",
    "work_timestamps": {"completed_at": "2026-02-02T00:00:00Z"},
    "schedule": {"scheduled_start": "2026-02-01T08:00:00-06:00"},
    "assigned_employees": [{"id": "e1", "first_name": "Ann", "role": None}, {"id": "e2"}],
    "something_new": {"deep": [1]},
}


def test_all_envelopes(spark, tmp_path):
    path = land(
        tmp_path,
        "jobs",
        {"jobs": [JOB, {"id": "j2"}], "total_pages": 4, "page": 1},
        {"data": [{"id": "j3"}], "total_pages_count": 4},
        {"jobs": [], "data": [{"id": "j4"}]},
        {"jobs": []},
        {"message": "nothing here"},
    )
    assert sorted(r["id"] for r in dicts(read_items(spark, path, "jobs"))) == ["j1", "j2", "j3", "j4"]
    pages = dicts(page_envelope(read_pages(spark, f"{path}/jobs", "jobs"), "jobs"))
    assert sorted(p["total_pages"] or 0 for p in pages) == [0, 0, 0, 4, 4]


def test_missing_folder_reads_as_no_items(spark, tmp_path):
    assert read_items(spark, str(tmp_path), "pricebook_materials").count() == 0


def test_invoices_may_come_under_jobs(spark, tmp_path):
    path = land(tmp_path, "invoices", {"invoices": [], "jobs": [{"id": 5}]}, {"invoices": [{"id": 6}]})
    assert sorted(r["id"] for r in dicts(read_items(spark, path, "invoices"))) == ["5", "6"]


def test_one_page_per_line(spark, tmp_path):
    (tmp_path / "customers").mkdir()
    lines = [{"customers": [{"id": "a"}, {"id": "b"}]}, {"data": [{"id": "c"}]}]
    (tmp_path / "customers" / "x.json").write_text("\n".join(json.dumps(x) for x in lines))
    assert sorted(r["id"] for r in dicts(read_items(spark, str(tmp_path), "customers", True))) == ["a", "b", "c"]


def test_jobs(spark, tmp_path):
    path = land(tmp_path, "jobs", {"jobs": [JOB, {"id": "j2", "tags": []}]})
    items = read_items(spark, path, "jobs")
    first, second = sorted(dicts(flatten.jobs(items)), key=lambda r: r["job_id"])
    assert first["customer_id"] == "c1" and first["tags"] == "Residential,Install"
    assert first["total_amount"] == 12345 and first["invoice_number"] == "17"
    assert first["completed_at"].isoformat() == "2026-02-02T00:00:00"
    assert first["scheduled_start"].isoformat() == "2026-02-01T14:00:00"
    assert first["num_appointments"] is None and first["company_name"] is None
    assert second["tags"] is None and second["customer_id"] is None and second["completed_at"] is None
    crew = dicts(flatten.job_employees(items))
    assert sorted((r["job_id"], r["employee_id"], r["first_name"]) for r in crew) == [
        ("j1", "e1", "Ann"),
        ("j1", "e2", None),
    ]


def test_appointments(spark, tmp_path):
    visits = [
        {"id": "a1", "start_time": "2026-01-01T10:00:00Z", "dispatched_employees_ids": ["e1", "e2"]},
        {"id": "a2", "dispatched_employees_ids": []},
        {"id": "a3", "anytime": True, "arrival_window_minutes": 60},
    ]
    path = land(
        tmp_path,
        "job_details",
        {"id": 7, "schedule": {"appointments": visits}},
        {"id": 8, "schedule": None},
        {"id": 9, "schedule": {"appointments": []}},
        {"id": 7, "schedule": {"appointments": visits[:1]}},
    )
    items = read_items(spark, path, "job_details").filter("id = 7 AND size(schedule.appointments) = 3")
    rows = dicts(flatten.job_appointments(items))
    assert sorted((r["appointment_id"], str(r["dispatched_employee_id"])) for r in rows) == [
        ("a1", "e1"), ("a1", "e2"), ("a2", "None"), ("a3", "None"),
    ]
    assert [r["anytime"] for r in rows if r["appointment_id"] == "a3"] == [True]
    counts = {r["job_id"]: r["num_appointments"] for r in dicts(flatten.appointment_counts(read_items(spark, path, "job_details")))}
    assert counts == {"7": 1, "8": 0, "9": 0}  # of job 7 the detail that arrived last
    jobs = flatten.jobs(page_items(read_pages(spark, land(tmp_path, "jobs", {"jobs": [{"id": "7"}, {"id": "99"}]}) + "/jobs", "jobs"), "jobs"))
    joined = flatten.with_appointment_counts(jobs, flatten.appointment_counts(read_items(spark, path, "job_details")))
    assert {r["job_id"]: r["num_appointments"] for r in dicts(joined)} == {"7": 1, "99": 0}


def test_invoices_and_estimates(spark, tmp_path):
    path = land(
        tmp_path,
        "invoices",
        {"invoices": [
            {"id": 1, "job_id": None, "amount": 500, "items": [{"id": None, "name": "Club", "amount": 5}, {"id": "l"}]},
            {"id": 2, "job_id": 3, "items": None},
        ]},
    )
    items = read_items(spark, path, "invoices")
    headers = {r["invoice_id"]: r["job_id"] for r in dicts(flatten.invoices(items))}
    assert headers == {"1": None, "2": "3"}
    lines = dicts(flatten.invoice_items(items))
    assert sorted((r["invoice_id"], str(r["item_id"]), str(r["amount"])) for r in lines) == [("1", "None", "5"), ("1", "l", "None")]
    land(
        tmp_path,
        "estimates",
        {"estimates": [{"id": "e", "customer": None, "assigned_employees": [{"id": 4}], "options": [
            {"id": "o1", "total_amount": 100, "status": "x"}, {"id": "o2", "approval_status": "approved"}]}, {"id": "f"}]},
    )
    estimates = read_items(spark, path, "estimates")
    assert {r["estimate_id"] for r in dicts(flatten.estimates(estimates))} == {"e", "f"}
    assert {(r["option_id"], r["estimate_id"], r["total_amount"]) for r in dicts(flatten.estimate_options(estimates))} == {
        ("o1", "e", 100), ("o2", "e", None),
    }
    crew = dicts(flatten.estimate_employees(estimates))
    assert [(r["estimate_id"], r["employee_id"]) for r in crew] == [("e", "4")]


def test_price_book(spark, tmp_path):
    path = land(
        tmp_path,
        "pricebook_services",
        {"data": [{"uuid": "u1", "id": "x", "price": 9.5, "category": {"name": "HVAC"}}, {"id": "i2"}, {"name": "no key"}],
         "total_pages_count": 2},
        {"checklists": [{"data": [{"uuid": "", "id": "i3", "industry_name": "Air"}], "page": 2, "total_pages": 2, "total_items": 3}]},
        {"checklists": []},
    )
    services = {r["service_uuid"]: r for r in dicts(flatten.pricebook_services(read_items(spark, path, "pricebook_services")))}
    assert set(services) == {"u1", "i2", "i3"}
    assert services["u1"]["category_name"] == "HVAC" and services["u1"]["price"] == 9.5
    assert services["i3"]["industry_name"] == "Air"


@pytest.mark.parametrize(("updated", "kept"), [
    ("2026-06-02T12:00:00Z", True), ("2026-06-02T11:59:59Z", False), ("2027-01-01", True), ("bad", True), (None, True),
])
def test_look_back(spark, updated, kept):
    items = spark.createDataFrame([("a", updated)], "id string, updated_at string")
    found = updated_within(items, instant("2026-08-01T12:00:00Z"), 60).count()
    assert found == kept


def test_days_of_arrival_prune_the_scan(spark, tmp_path):
    for day, number in (("2026-05-01", 1), ("2026-06-03", 2), ("2026-07-30", 3)):
        changed = {"id": f"j{number}", "updated_at": f"{day}T08:00:00Z"}
        land(tmp_path / "landing" / "jobs", f"load_date={day}", {"jobs": [changed]})
    landing = str(tmp_path / "landing")
    since = instant("2026-06-02T12:00:00Z")
    recent = read_items(spark, landing, "jobs", since=since)
    assert sorted(r["id"] for r in dicts(recent)) == ["j2", "j3"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan
    assert read_items(spark, landing, "jobs").count() == 3


def test_jobs_wanting_details(spark):
    rows = [
        dict(job_id="a", work_status="complete rated", completed_at="2026-07-01T00:00:00Z"),
        dict(job_id="b", work_status="Complete Rated", completed_at="2026-07-01T00:00:00Z"),
        dict(job_id="c", work_status="complete unrated", completed_at="2026-01-01T00:00:00Z", updated_at="2026-07-01T00:00:00Z"),
        dict(job_id="d", work_status="complete unrated"),
        dict(job_id=None, work_status="complete unrated"),
    ]
    jobs = table(spark, "jobs", *rows)
    assert sorted(r["job_id"] for r in dicts(flatten.jobs_wanting_details(jobs))) == ["a", "c", "d"]
    late = flatten.jobs_wanting_details(jobs, instant("2026-06-17T00:00:00Z"))
    assert sorted(r["job_id"] for r in dicts(late)) == ["a", "c"]


def test_price_book_materials_and_schema_listing(spark, tmp_path):
    path = land(tmp_path, "pricebook_materials", {"data": [{"uuid": "m1", "part_number": 5, "cost": 2.5}, {"name": "no key"}]})
    materials = flatten.pricebook_materials(read_items(spark, path, "pricebook_materials"))
    assert [(r["material_uuid"], r["part_number"], r["cost"]) for r in dicts(materials)] == [("m1", "5", 2.5)]
    listed = dicts(schema_listing(spark, {"pricebook_materials": materials}))
    assert listed[0] == {"table": "pricebook_materials", "position": 0, "column": "material_uuid", "type": "string"}
    assert len(listed) == 8


def test_missing_pages(spark, tmp_path):
    """Announced by either counter, in either shape, told apart by pull; without counters a pull is one page."""
    listed = lambda number, total: {"checklists": [{"data": [], "page": number, "total_pages": total}]}
    land(tmp_path, "jobs/load_date=2026-01-01", {"jobs": [], "page": 1, "total_pages": 2}, {"data": [], "page": 4, "total_pages_count": 4}, {"jobs": [], "page": 4, "total_pages": 4})
    land(tmp_path, "jobs/load_date=2026-01-02", listed(2, 3), {"jobs": [JOB]})
    land(tmp_path, "jobs/load_date=2026-01-03", {"jobs": [JOB]})
    pages = read_pages(spark, str(tmp_path / "jobs"), "jobs")
    found = {(str(r["load_date"]), r["page"], r["total_pages"]) for r in dicts(missing_pages(pages, ["load_date"]))}
    assert found == {("2026-01-01", 2, 4), ("2026-01-01", 3, 4), ("2026-01-02", 3, 3)}
    assert {r["page"] for r in dicts(missing_pages(pages))} == {3}
    assert dicts(missing_pages(read_pages(spark, str(tmp_path / "none"), "jobs"))) == []


def test_minutes_of_visits_are_kept(spark, tmp_path):
    path = land(tmp_path, "job_details", {"id": "j1", "schedule": {"appointments": [{"id": "a", "duration_minutes": 45.5}, {"id": "b"}]}})
    rows = dicts(flatten.job_appointments(read_items(spark, path, "job_details")))
    assert {r["appointment_id"]: r["duration_minutes"] for r in rows} == {"a": 45.5, "b": None}
