"""All KPIs together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.plans import audit, club, employees, estimates, freshness, leads, quality, revenue
from wrenchlight.plans.context import Context

# KPIs of one row each.
SUMMARIES: dict[str, Callable[[Context], DataFrame]] = {
    "quality_summary": quality.quality_summary,
    "revenue_total": revenue.revenue_total,
    "average_ticket": revenue.average_ticket,
    "estimates_count": estimates.estimates_count,
    "lead_summary": leads.lead_summary,
    "club_summary": club.club_summary,
    "freshness": freshness.freshness,
}

# KPIs of several rows.
BREAKDOWNS: dict[str, Callable[[Context], DataFrame]] = {
    "repeat_jobs": quality.repeat_jobs,
    "dfo_monthly": quality.dfo_monthly,
    "revenue_breakdown": revenue.revenue_breakdown,
    "employee_cards": employees.employee_cards,
    "option_status_breakdown": estimates.option_status_breakdown,
    "lead_by_month": leads.lead_by_month,
    "lead_by_source": leads.lead_by_source,
    "lead_by_employee": leads.lead_by_employee,
    "club_monthly": club.club_monthly,
}

AUDITS: dict[str, Callable[[Context], DataFrame]] = {
    "club_audit": audit.club_audit,
    "job_baseline": audit.job_baseline,
    "load_facts": freshness.load_facts,
}


def dashboard(ctx: Context) -> dict[str, DataFrame]:
    """Every KPI of the dashboard by name, all lazy."""
    return {name: plan(ctx) for name, plan in {**SUMMARIES, **BREAKDOWNS}.items()}


def dashboard_values(ctx: Context) -> DataFrame:
    """(kpi, measure, value): all one-row KPIs as one long frame, values as text."""
    parts = []
    for name, plan in SUMMARIES.items():
        summary = plan(ctx)
        measures = [c for c in summary.columns]
        texts = summary.select([F.col(c).cast("string").alias(c) for c in measures])
        long = texts.unpivot([], measures, "measure", "value")
        parts.append(long.select(F.lit(name).alias("kpi"), "measure", "value"))
    return reduce(DataFrame.unionByName, parts)


def write_dashboard(ctx: Context, folder: str) -> dict[str, str]:
    """Write each KPI to Parquet below ``folder`` and return the paths.

    The shared populations are written first and read back for all KPIs.
    """
    shared = ctx.materialized(f"{folder}/_populations")
    # The club's figures of the year and of its months come from one aggregation.
    shared.keep("club_months", club.club_months(shared), f"{folder}/_populations")
    paths = {}
    for name, frame in dashboard(shared).items():
        paths[name] = f"{folder}/{name}"
        frame.write.parquet(paths[name])
    return paths
