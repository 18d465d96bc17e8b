"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenchlight.plans import audit, club, dashboard, employees, estimates, freshness, leads, quality, revenue
from wrenchlight.plans.context import Context
from wrenchlight.session import shared_folder
from wrenchlight.sources import bucketed
from wrenchlight.sources.tables import Tables
from workload import bridge, expressions, ingestion

Query = Callable[[SparkSession, str], DataFrame]

EVENTS_AS_OF = "2024-01-31T00:30:00+00:00"


def _kpi(plan: Callable[[Context], DataFrame], as_of: str = bridge.AS_OF) -> Query:
    return lambda spark, folder: plan(bridge.context(spark, folder, as_of))


def _kpi_by_job(plan: Callable[[Context], DataFrame]) -> Query:
    """The KPI from copies of the tables bucketed by job, written first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = bucketed.write_by_job(bridge.tables(spark, folder), shared_folder(spark, "by-job"))
        return plan(Context(tables, bridge.AS_OF))

    return run


def employee_hours_given(spark: SparkSession, folder: str) -> DataFrame:
    """Hours where every third visit comes with its minutes, every ninth with none of its times, and some minutes are 0 or less."""
    tables = bridge.tables(spark, folder)
    visits = bridge.given(spark, folder, "lineitem").selectExpr(
        "concat('job_', l_orderkey) AS job_id",
        "cast(l_linenumber AS string) AS appointment_id",
        "cast(l_suppkey AS string) AS dispatched_employee_id",
        "cast(l_shipdate AS timestamp) AS start_time",
        "CASE WHEN l_orderkey % 9 <> 0 THEN cast(l_shipdate AS timestamp) + make_dt_interval(0, 0, cast(l_quantity * 6 AS int)) END AS end_time",
        "CASE WHEN l_orderkey % 3 = 0 THEN cast(l_partkey % 100 - 10 AS double) END AS duration_minutes",
    )
    frames = Tables(spark, lambda name: visits if name == "job_appointments" else tables[name])
    return employees.employee_hours(Context(frames, bridge.AS_OF))


KPIS: dict[str, Query] = {
    "quality_summary": _kpi(quality.quality_summary),
    "repeat_jobs_top25": _kpi(quality.repeat_jobs),
    "dfo_monthly": _kpi(quality.dfo_monthly),
    "revenue_total": _kpi(revenue.revenue_total),
    "revenue_breakdown": _kpi(revenue.revenue_breakdown),
    "avg_ticket_split": _kpi(revenue.average_ticket),
    "employee_completed": _kpi(employees.employee_completed),
    "employee_avg_ticket": _kpi(employees.employee_average_ticket),
    "employee_callbacks": _kpi(employees.employee_callbacks),
    "employee_daily_revenue": _kpi(employees.employee_daily_revenue),
    "employee_hours": _kpi(employees.employee_hours),
    "employee_cards": _kpi(employees.employee_cards),
    "employee_hours_given": employee_hours_given,
    "estimates_ytd": _kpi(estimates.estimates_count),
    "option_status_breakdown": _kpi(estimates.option_status_breakdown),
    "lead_summary": _kpi(leads.lead_summary),
    "lead_by_month": _kpi(leads.lead_by_month),
    "lead_by_source": _kpi(leads.lead_by_source),
    "lead_by_employee": _kpi(leads.lead_by_employee),
    "club_summary": _kpi(club.club_summary),
    "club_monthly": _kpi(club.club_monthly),
    "club_audit": _kpi(audit.club_audit),
    "job_baseline_audit": _kpi(audit.job_baseline),
    "freshness": _kpi(freshness.freshness, EVENTS_AS_OF),
    "load_facts": _kpi(freshness.load_facts),
    "dashboard_values": _kpi(dashboard.dashboard_values),
    "revenue_breakdown_bucketed": _kpi_by_job(revenue.revenue_breakdown),
    "employee_cards_bucketed": _kpi_by_job(employees.employee_cards),
}


def queries() -> dict[str, Query]:
    return {**KPIS, **expressions.QUERIES, **ingestion.QUERIES}
