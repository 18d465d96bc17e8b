"""Scorecards per employee."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.labels import at_least, up_to_levels
from wrenchlight.functions.numbers import currency, dollars, fixed_point, percent, ratio
from wrenchlight.functions.text import is_callback, or_default
from wrenchlight.functions.times import day_of, worked_micros
from wrenchlight.plans.context import Context
from wrenchlight.plans.revenue import AVERAGE_TICKET_TARGET

# Dollars per service day to reach, and the callback share to stay within.
DAILY_REVENUE_TARGET = 1350.0
CALLBACK_TARGET = 5.0

# Facts about a job that are credited to every member of its crew.
FACTS = ("completed_jobs", "callback_jobs", "billed_jobs", "billed_cents", "service_cents")


def _facts(frame: DataFrame, day: Column | None = None, **values: Column) -> DataFrame:
    """One fact row per row of ``frame``; facts not given are 0."""
    columns = [F.col("job_id"), (F.lit(None).cast("date") if day is None else day).alias("day")]
    for name in FACTS:
        columns.append(values.get(name, F.lit(0)).cast("bigint").alias(name))
    return frame.select(*columns)


def _completed_facts(ctx: Context) -> DataFrame:
    callback = is_callback("tags_norm").cast("bigint")
    return _facts(ctx.completed, completed_jobs=F.lit(1), callback_jobs=callback)


def _billed_per_day(ctx: Context) -> DataFrame:
    """(job_id, day, cents): a job with any number of invoices is a few rows."""
    day = day_of("invoice_date").alias("day")
    return ctx.billed.groupBy("job_id", day).agg(F.sum("cents").alias("cents"))


def _billed_facts(ctx: Context) -> DataFrame:
    per_job = _billed_per_day(ctx).groupBy("job_id").agg(F.sum("cents").alias("cents"))
    return _facts(per_job, billed_jobs=F.lit(1), billed_cents=F.col("cents"))


def _service_facts(ctx: Context) -> DataFrame:
    """Service revenue per job and day: everything but the jobs labelled as installs."""
    service = _billed_per_day(ctx).join(ctx.install_jobs, "job_id", "left_anti")
    return _facts(service, day=F.col("day"), service_cents=F.col("cents"))


_FACT_SOURCES = {"completed": _completed_facts, "billed": _billed_facts, "service": _service_facts}


def crew_metrics(ctx: Context, kinds: Collection[str] = tuple(_FACT_SOURCES)) -> DataFrame:
    """Per employee: the facts of all jobs the employee is on, and the number of service days.

    All facts are stacked, one or a few rows per job, and meet the crews in one
    join. Both sides come straight from a shuffle on the job, so AQE is free to split the crew of a
    very large job. Crew entries that occur several times are taken once behind the join, where only the year's are left.
    """
    stacked = [_FACT_SOURCES[kind](ctx).withColumn("fact", F.lit(kind)) for kind in kinds]
    facts = reduce(DataFrame.unionByName, stacked)
    credited = ctx.crew.join(facts, "job_id").distinct()
    sums = [F.sum(name).alias(name) for name in FACTS]
    per_day = credited.groupBy("employee_id", "day").agg(*sums)
    return per_day.groupBy("employee_id").agg(*sums, F.count("day").alias("service_days"))


def appointment_hours(ctx: Context, strict: bool = False) -> DataFrame:
    """(employee_id, appt_hours): given length of all dispatched visits, of any year, or else the time between start and end.

    strict: the hours as the published dashboard shows them, which is none.
    """
    visits = ctx.tables["job_appointments"].filter(F.col("dispatched_employee_id").isNotNull())
    if strict:
        visits = visits.filter(F.lit(False))
    micros = worked_micros("start_time", "end_time", "duration_minutes")
    return visits.groupBy(F.col("dispatched_employee_id").alias("employee_id")).agg(
        (F.sum(micros) / F.lit(3_600_000_000)).alias("appt_hours")
    )


def employee_completed(ctx: Context) -> DataFrame:
    metrics = crew_metrics(ctx, ("completed",))
    return metrics.select("employee_id", F.col("completed_jobs").alias("completed_jobs_ytd"))


def employee_average_ticket(ctx: Context) -> DataFrame:
    """The whole invoice counts for every crew member; the count is of jobs, not invoices."""
    return crew_metrics(ctx, ("billed",)).select(
        "employee_id",
        ratio(dollars("billed_cents"), F.col("billed_jobs")).alias("avg_ticket_overall"),
        F.col("billed_jobs").alias("overall_invoice_count"),
    )


def employee_callbacks(ctx: Context) -> DataFrame:
    metrics = crew_metrics(ctx, ("completed",)).filter("callback_jobs > 0")
    return metrics.select("employee_id", F.col("callback_jobs").alias("callback_jobs_ytd"))


def employee_daily_revenue(ctx: Context) -> DataFrame:
    metrics = crew_metrics(ctx, ("service",))
    daily = ratio(dollars("service_cents"), F.col("service_days")).alias("daily_revenue_service")
    return metrics.select("employee_id", daily)


def employee_hours(ctx: Context, strict: bool = False) -> DataFrame:
    return appointment_hours(ctx, strict).withColumnRenamed("appt_hours", "appt_hours_ytd")


def employee_cards(ctx: Context, strict: bool = False) -> DataFrame:
    """One card per employee, most completed jobs first.

    Gross profit per hour has no agreed formula and stays "Pending".
    """
    metrics = crew_metrics(ctx).unionByName(appointment_hours(ctx, strict), allowMissingColumns=True)
    totals = metrics.groupBy("employee_id").agg(
        *[F.sum(name).alias(name) for name in (*FACTS, "service_days", "appt_hours")]
    )
    cards = ctx.employees.join(totals, "employee_id", "left").fillna(0, [*FACTS, "service_days", "appt_hours"])
    measured = cards.withColumns(
        {
            "avg_ticket_overall": ratio(dollars("billed_cents"), F.col("billed_jobs")),
            "daily_revenue": ratio(dollars("service_cents"), F.col("service_days")),
            "callback_pct_ytd": percent("callback_jobs", "completed_jobs"),
        }
    )
    return measured.orderBy(F.desc("completed_jobs"), "employee_id").select(
        "employee_id",
        F.col("employee_name").alias("name"),
        or_default("role", "Technician").alias("role"),
        "avatar_url",
        "color_hex",
        F.col("completed_jobs").alias("completed_jobs_ytd"),
        "avg_ticket_overall",
        currency("avg_ticket_overall").alias("avg_ticket_overall_display"),
        at_least("avg_ticket_overall", AVERAGE_TICKET_TARGET).alias("avg_ticket_overall_status"),
        F.col("billed_jobs").alias("overall_invoice_count"),
        "daily_revenue",
        currency("daily_revenue").alias("daily_revenue_display"),
        at_least("daily_revenue", DAILY_REVENUE_TARGET).alias("daily_revenue_status"),
        F.col("callback_jobs").alias("callback_jobs_ytd"),
        "callback_pct_ytd",
        fixed_point("callback_pct_ytd", 1, "%").alias("callback_pct_display"),
        up_to_levels("callback_pct_ytd", CALLBACK_TARGET, CALLBACK_TARGET * 2).alias("callback_status"),
        F.lit(CALLBACK_TARGET).alias("callback_target"),
        F.col("appt_hours").alias("appt_hours_ytd"),
        fixed_point("appt_hours", 1, " hrs").alias("appt_hours_ytd_display"),
        F.lit(0.0).alias("gross_profit_per_hour_ytd"),
        F.lit("Pending").alias("gross_profit_per_hour_ytd_display"),
        F.lit(0.0).alias("gp_per_hour_target"),
        F.lit(True).alias("gp_per_hour_pending"),
        F.lit("secondary").alias("gp_per_hour_status"),
    )
