"""KPIs on small hand-written tables; expected values worked out by hand."""

from __future__ import annotations

import pytest

from tests.frames import context, dicts, one
from wrenchlight.plans import audit, club, employees, estimates, freshness, leads, quality, revenue
from wrenchlight.plans.dashboard import AUDITS, BREAKDOWNS, SUMMARIES, dashboard, dashboard_values, write_dashboard

DONE, DONE_TOO = "complete rated", "Complete Unrated"

JOBS = [
    # The year starts at 06:00 UTC.
    dict(job_id="early", work_status=DONE, completed_at="2026-01-01T05:59:59Z", tags="dfo"),
    dict(job_id="j1", work_status=DONE, completed_at="2026-01-01T06:00:00Z", tags="Residential, Service, DFO", customer_id="c1"),
    dict(job_id="j2", work_status=DONE_TOO, completed_at="2026-02-01T00:30:00Z", tags="Commercial,Install", customer_id="c2", description="Club member"),
    dict(job_id="j3", work_status=DONE, completed_at="2026-02-03T00:00:00Z", tags=None, customer_id="gone", num_appointments=2, description="x"),
    dict(job_id="j4", work_status=DONE, completed_at="2027-05-01T00:00:00Z", tags="New Construction, Install, Call Back", description="wizard"),
    dict(job_id="j5", work_status="in progress", completed_at="2026-03-01T00:00:00Z", tags="dfo"),
    dict(job_id="j6", work_status=DONE, completed_at=None, tags=""),
    dict(job_id="j7", work_status=" complete rated ", completed_at="2026-03-01T00:00:00Z", tags="replacement"),
]
CUSTOMERS = [dict(customer_id="c1", first_name=" Ann ", last_name="Lee"), dict(customer_id="c2", first_name=None, last_name="Ray")]
VISITS = [
    dict(job_id="j1", appointment_id="a", dispatched_employee_id="e1", start_time="2026-01-01T10:00:00Z", end_time="2026-01-01T11:30:00Z"),
    dict(job_id="j1", appointment_id="a", dispatched_employee_id="e2", start_time="2026-01-01T10:00:00Z", end_time="2026-01-01T11:30:00Z"),
    dict(job_id="j2", appointment_id="a", dispatched_employee_id=None, start_time="2020-01-01T10:00:00Z", end_time="2020-01-01T12:00:00Z"),
    dict(job_id="j2", appointment_id="b", dispatched_employee_id="e1", start_time="2020-01-01T10:00:00Z", end_time="2020-01-01T12:00:00Z"),
    dict(job_id="j4", appointment_id=None, dispatched_employee_id="e1", start_time="2026-01-01T10:00:00Z"),
]
INVOICES = [
    dict(invoice_id="i1", job_id="j1", status="open", amount=10_000, invoice_date="2026-01-05T00:00:00Z"),
    dict(invoice_id="i2", job_id="j1", status="Pending_Payment", amount=20_000, invoice_date="2026-01-05T20:00:00Z"),
    dict(invoice_id="i3", job_id="j2", status="open", amount=90_000, invoice_date="2026-02-05T00:00:00Z"),
    dict(invoice_id="i4", job_id=None, status="open", amount=None, invoice_date="2026-02-05T00:00:00Z"),
    dict(invoice_id="i5", job_id="j4", status="open", amount=40_000, invoice_date="2026-02-07T00:00:00Z"),
    dict(invoice_id="i6", job_id="j1", status="paid", amount=70_000, invoice_date="2026-02-07T00:00:00Z"),
    dict(invoice_id="i7", job_id="j3", status="open", amount=70_000, invoice_date="2026-01-01T05:00:00Z"),
]
ITEMS = [
    dict(invoice_id="i6", job_id="other", item_id="1", name="Wizard CLUB plan"),
    dict(invoice_id="i6", job_id="other", item_id="2", name="club"),
    dict(invoice_id="i7", job_id="j3", item_id="1", name="club"),
    dict(invoice_id="i4", job_id="j3", item_id=None, name="membership"),
    dict(invoice_id="i5", job_id="j4", item_id="1", name="screws"),
]
CREW = [
    dict(job_id="j1", employee_id="e1"), dict(job_id="j1", employee_id="e1"), dict(job_id="j1", employee_id="e2"),
    dict(job_id="j2", employee_id="e1"), dict(job_id="j4", employee_id="e2"), dict(job_id="j5", employee_id="e1"),
    dict(job_id="j3", employee_id=None), dict(job_id="j4", employee_id="ghost", first_name="Gus"),
]
EMPLOYEES = [
    dict(employee_id="e1", first_name="Eve", last_name="One", role="Lead"),
    dict(employee_id="e2", first_name=" ", last_name=None, role=" "),
    dict(employee_id="e3", first_name="Idle", last_name="Three", role=None),
]
ESTIMATES = [
    dict(estimate_id="s1", lead_source=" Web ", created_at="2026-01-01T06:00:00Z"),
    dict(estimate_id="s2", lead_source="Web", created_at="2026-02-01T00:00:00Z"),
    dict(estimate_id="s3", lead_source=None, created_at="2026-02-02T00:00:00Z"),
    dict(estimate_id="s4", lead_source="", created_at="2025-12-31T00:00:00Z"),
]
OPTIONS = [
    dict(option_id="1", estimate_id="s1", status="declined", total_amount=100),
    dict(option_id="2", estimate_id="s1", approval_status="Approved", total_amount=250),
    dict(option_id="3", estimate_id="s2", approval_status="declined", status="waiting"),
    dict(option_id="4", estimate_id="s4", approval_status="approved", total_amount=50),
    dict(option_id="5", estimate_id=None, status=None, total_amount=1),
]
BRIDGE = [
    dict(estimate_id="s1", employee_id="e1"), dict(estimate_id="s1", employee_id="twin"), dict(estimate_id="s2", employee_id="e1"),
    dict(estimate_id="s3", employee_id=None), dict(estimate_id="s4", employee_id="e1"), dict(estimate_id="s2", employee_id="nobody"),
    dict(estimate_id="s3", employee_id="raw"), dict(estimate_id="s3", employee_id="guest", first_name="Guest", last_name="Tech"),
]
TWINS = [
    dict(employee_id="twin", first_name="Eve", last_name="One"),
    dict(employee_id="raw", first_name="pro_" + "0f" * 16),
]


@pytest.fixture(scope="module")
def ctx(spark):
    return context(
        spark, jobs=JOBS, customers=CUSTOMERS, job_appointments=VISITS, invoices=INVOICES, invoice_items=ITEMS,
        job_employees=CREW, employees=EMPLOYEES, estimates=ESTIMATES, estimate_options=OPTIONS,
        estimate_employees=BRIDGE,
    )


def test_quality(ctx):
    found = one(quality.quality_summary(ctx))
    assert found["completed_jobs"] == 4 and found["first_time_completed"] == 1
    # j2 by its appointments, j3 by its stored number; j4 has neither.
    assert found["repeat_visit_completed"] == 2 and found["repeat_visit_pct"] == 50.0
    assert (found["dfo_count"], found["dfo_pct"], found["dfo_status_color"]) == (1, 25.0, "danger")


def test_repeat_jobs(ctx):
    assert [(r["job_id"], r["customer_name"], r["num_appointments"], r["completed_at_central"]) for r in dicts(quality.repeat_jobs(ctx))] == [
        ("j3", "Unknown", 2, "Feb 02, 2026 06:00 PM"),
        ("j2", "Unknown Ray", 2, "Jan 31, 2026 06:30 PM"),
    ]
    assert [r["job_id"] for r in dicts(quality.repeat_jobs(ctx, 1))] == ["j3"]


def test_dfo_monthly(spark, ctx):
    assert [(r["month"], r["dfo_count"], r["total_count"], r["dfo_pct"]) for r in dicts(quality.dfo_monthly(ctx))] == [
        ("2026-01", 1, 1, 100.0), ("2026-02", 0, 2, 0.0), ("2027-05", 0, 1, 0.0),
    ]
    assert dicts(quality.dfo_monthly(context(spark, jobs=[JOBS[2]]))) == []


def test_revenue(ctx):
    assert one(revenue.revenue_total(ctx)) == {"total_revenue_ytd": 1600.0, "total_revenue_ytd_display": "$1,600"}
    rows = dicts(revenue.revenue_breakdown(ctx))
    assert [(r["category"], r["revenue"], r["pct_of_total_display"]) for r in rows] == [
        ("Commercial Install", 900.0, "56%"), ("New Construction", 400.0, "25%"),
        ("Residential Service", 300.0, "19%"), ("Other / Unclassified", 0.0, "0%"),
    ]
    assert sum(r["pct_of_total"] for r in rows) == 100 and rows[0]["pct_of_max"] == 100.0
    ticket = one(revenue.average_ticket(ctx))
    assert (ticket["average_ticket"], ticket["invoice_count"], ticket["average_ticket_status"]) == (320.0, 5, "danger")
    assert (ticket["install_avg_ticket"], ticket["install_invoice_count"], ticket["install_avg_ticket_status"]) == (900.0, 1, "success")
    assert (ticket["service_avg_ticket"], ticket["service_invoice_count"]) == (175.0, 4)


def test_revenue_of_nothing_still_adds_up(spark):
    zero = context(spark, invoices=[dict(INVOICES[3])], jobs=JOBS)
    assert [(r["pct_of_total"], r["pct_of_max"]) for r in dicts(revenue.revenue_breakdown(zero))] == [(100.0, 0.0)]


def test_employee_cards(ctx):
    cards = {r["employee_id"]: r for r in dicts(employees.employee_cards(ctx))}
    # The ghost is not in the employees table and gets no card; the idle employee does.
    assert list(cards) == ["e1", "e2", "e3"]
    eve, blank, idle = cards["e1"], cards["e2"], cards["e3"]
    assert (eve["name"], eve["role"], blank["name"], blank["role"], idle["role"]) == ("Eve One", "Lead", "Unknown", "Technician", "Technician")
    assert (eve["completed_jobs_ytd"], blank["completed_jobs_ytd"], idle["completed_jobs_ytd"]) == (2, 2, 0)
    # e1: jobs j1 (300) and j2 (900); e2: j1 (300) and j4 (400).
    assert (eve["avg_ticket_overall"], eve["overall_invoice_count"], eve["avg_ticket_overall_status"]) == (600.0, 2, "success")
    assert (blank["avg_ticket_overall"], blank["overall_invoice_count"]) == (350.0, 2)
    # Service only: j2 is an install, j4 counts as service; j1 has both invoices on one day.
    assert (eve["daily_revenue"], blank["daily_revenue"]) == (300.0, 350.0)
    assert (blank["callback_jobs_ytd"], blank["callback_pct_ytd"], blank["callback_pct_display"], blank["callback_status"]) == (1, 50.0, "50.0%", "danger")
    assert (eve["callback_status"], idle["callback_pct_display"]) == ("success", "0.0%")
    assert (eve["appt_hours_ytd"], eve["appt_hours_ytd_display"], idle["appt_hours_ytd"]) == (3.5, "3.5 hrs", 0.0)
    assert eve["gross_profit_per_hour_ytd_display"] == "Pending" and eve["gp_per_hour_pending"] is True
    strict = {r["employee_id"]: r["appt_hours_ytd"] for r in dicts(employees.employee_cards(ctx, strict=True))}
    assert strict == {"e1": 0.0, "e2": 0.0, "e3": 0.0}


def test_employee_parts(ctx):
    assert {r["employee_id"]: r["completed_jobs_ytd"] for r in dicts(employees.employee_completed(ctx))} == {"e1": 2, "e2": 2, "ghost": 1}
    assert {r["employee_id"]: r["callback_jobs_ytd"] for r in dicts(employees.employee_callbacks(ctx))} == {"e2": 1, "ghost": 1}
    assert {r["employee_id"]: r["daily_revenue_service"] for r in dicts(employees.employee_daily_revenue(ctx))} == {"e1": 300.0, "e2": 350.0, "ghost": 400.0}


def test_employees_out_of_crews(spark):
    crew = [
        dict(job_id="a", employee_id="e", first_name="Ann"), dict(job_id="b", employee_id="e", first_name="Ann", role="Lead"),
        dict(job_id="b", employee_id=None, first_name="No one"),
    ]
    found = dicts(context(spark, job_employees=crew).employees)
    assert [(r["employee_id"], r["employee_name"], r["role"]) for r in found] == [("e", "Ann", "Lead")]


def test_estimates(ctx):
    assert one(estimates.estimates_count(ctx)) == {"estimates_ytd_count": 3}
    assert [tuple(r.values()) for r in dicts(estimates.option_status_breakdown(ctx))] == [
        ("approved", 2, 3.0, "$3"), ("declined", 2, 1.0, "$1"), ("unknown", 1, 0.01, "$0"),
    ]


def test_leads(ctx):
    assert one(leads.lead_summary(ctx)) == {
        "estimates_created_ytd": 3, "estimates_won_ytd": 1, "estimates_lost_ytd": 1, "estimates_pending_ytd": 1,
        "win_rate_ytd": 50.0, "calls_ytd": 4, "estimate_to_call_ratio": 0.75,
    }
    assert [(r["month"], r["estimates"], r["won"], r["lost"], r["win_rate"]) for r in dicts(leads.lead_by_month(ctx))] == [
        ("2026-01", 1, 1, 0, 100.0), ("2026-02", 2, 0, 1, 0.0),
    ]
    assert [(r["lead_source"], r["estimates"], r["pending"]) for r in dicts(leads.lead_by_source(ctx))] == [("Web", 2, 0), ("Unknown", 1, 1)]


@pytest.mark.parametrize(("distinct", "won"), [(False, 2), (True, 1)])
def test_leads_by_employee(spark, distinct, won):
    tables = dict(employees=EMPLOYEES + TWINS, estimates=ESTIMATES, estimate_options=OPTIONS, estimate_employees=BRIDGE)
    found = {r["employee_name"]: r for r in dicts(leads.lead_by_employee(context(spark, **tables), distinct))}
    # Two employees of one name on s1: one estimate, two assignments.
    assert (found["Eve One"]["estimates"], found["Eve One"]["won"], found["Eve One"]["lost"]) == (2, won, 1)
    # No employee, an unknown one, and one whose name is an id.
    assert (found["Unassigned"]["estimates"], found["Unassigned"]["lost"]) == (2, 1)
    assert found["Unassigned"]["pending"] == (1 if distinct else 2)
    assert found["Guest Tech"]["pending"] == 1 and set(found) == {"Eve One", "Unassigned", "Guest Tech"}


def test_club(ctx):
    found = one(club.club_summary(ctx))
    # Service calls: j1 and j3. j1 has the paid invoice i6, j3 only by the item's own job (i4 has none).
    assert (found["eligible_service_calls_ytd"], found["club_calls_ytd"], found["nonclub_service_calls_ytd"]) == (2, 2, 0)
    assert (found["club_calls_from_tags"], found["club_calls_from_description"], found["club_calls_from_invoice_items"]) == (0, 0, 2)
    assert (found["club_conversion_pct_display"], found["club_conversion_status"], found["pct_from_invoice_items"]) == ("100.00%", "success", 100.0)
    strict = one(club.club_summary(ctx, strict=True))
    assert (strict["club_calls_ytd"], strict["club_conversion_pct"], strict["club_conversion_status"]) == (0, 0.0, "danger")
    assert [(r["month"], r["service_calls"], r["club_calls"]) for r in dicts(club.club_monthly(ctx))] == [("2026-01", 1, 1), ("2026-02", 1, 1)]


def test_audits(ctx):
    found = one(audit.club_audit(ctx))
    # UTC year and trimmed states: "early" and "j7" are completed; j7 is a replacement.
    assert (found["service_calls_ytd"], found["club_calls_from_description"], found["club_calls_from_invoice_items"]) == (3, 0, 2)
    base = one(audit.job_baseline(ctx))
    assert (base["jobs_total"], base["completed_jobs_ytd_total"], base["null_tags_all_time"], base["empty_tags_all_time"]) == (8, 6, 1, 2)
    assert base["ytd_start_utc"] == "2026-01-01 00:00:00+00:00"
    counts = {r["table_name"]: r["row_count"] for r in dicts(audit.table_counts(ctx.tables, ("jobs", "pricebook_services")))}
    assert counts == {"jobs": 8, "pricebook_services": 0}
    assert [r["job_id"] for r in dicts(audit.table_sample(ctx.tables, "jobs", "completed_at", 2, "job_id"))] == ["j4", "j5"]


@pytest.mark.parametrize(("value", "can", "following", "shown"), [
    (None, True, "Now", "No data yet"),
    ("", True, "Now", "No data yet"),
    ("yesterday", True, "Now", "Unknown"),
    ("2026-08-01T11:00:00Z", True, "Aug 01, 2026 07:00 AM CDT", "Aug 01, 2026 06:00 AM CDT"),
    ("2026-08-01T11:00:01+00:00", False, "Aug 01, 2026 07:00 AM CDT", "Aug 01, 2026 06:00 AM CDT"),
])
def test_freshness(spark, value, can, following, shown):
    log = [dict(key="last_refresh", value="2020-01-01", recorded_at="2020-01-01"), dict(key="last_window_end", value="x", recorded_at="2026-01-01")]
    rows = [*log, dict(key="last_refresh", value=value, recorded_at="2026-08-01")] if value is not None else []
    found = one(freshness.freshness(context(spark, load_log=rows)))
    assert found == {"can_refresh": can, "next_refresh": following, "last_refresh_display": shown}


def test_every_kpi_of_empty_tables(spark):
    nothing = context(spark)
    for name, plan in {**SUMMARIES, **BREAKDOWNS, **AUDITS}.items():
        rows = dicts(plan(nothing))
        assert len(rows) == (1 if name in SUMMARIES or name in ("club_audit", "job_baseline") else 0), name
        for row in rows:
            unexpected = [k for k, v in row.items() if v is None]
            assert not unexpected, (name, unexpected)


def test_dashboard(spark, ctx, tmp_path):
    assert set(dashboard(ctx)) == set(SUMMARIES) | set(BREAKDOWNS)
    values = {(r["kpi"], r["measure"]): r["value"] for r in dicts(dashboard_values(ctx))}
    assert values["quality_summary", "completed_jobs"] == "4" and values["lead_summary", "calls_ytd"] == "4"
    paths = write_dashboard(ctx, str(tmp_path / "out"))
    assert spark.read.parquet(paths["employee_cards"]).count() == 3
    written = one(spark.read.parquet(paths["quality_summary"]))
    assert written == one(quality.quality_summary(ctx))
