"""First-time completion, repeat visits, DFO jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.functions.labels import below_levels
from wrenchlight.functions.numbers import percent
from wrenchlight.functions.text import customer_name, is_dfo
from wrenchlight.functions.times import display, month_of
from wrenchlight.operators.reports import lookup_for_few, newest_rows
from wrenchlight.plans.context import Context

# Target share of jobs done in one visit, and the limits of the DFO levels.
FIRST_TIME_TARGET = 85
DFO_GOOD_BELOW = 5
DFO_FAIR_BELOW = 10

REPEAT_JOBS_SHOWN = 25


def quality_summary(ctx: Context) -> DataFrame:
    """One row. A job without appointments is neither first-time nor repeat."""
    visits = F.col("num_appointments")
    totals = ctx.completed_visits.agg(
        F.count(F.lit(1)).alias("completed_jobs"),
        F.count_if(visits == 1).alias("first_time_completed"),
        F.count_if(visits >= 2).alias("repeat_visit_completed"),
        F.count_if(is_dfo("tags_norm")).alias("dfo_count"),
    )
    rated = totals.withColumns(
        {
            "first_time_completion_pct": percent("first_time_completed", "completed_jobs", 2),
            "repeat_visit_pct": percent("repeat_visit_completed", "completed_jobs", 2),
            "dfo_pct": percent("dfo_count", "completed_jobs", 2),
            "first_time_completion_target": F.lit(FIRST_TIME_TARGET),
        }
    )
    return rated.withColumn("dfo_status_color", below_levels("dfo_pct", DFO_GOOD_BELOW, DFO_FAIR_BELOW))


def repeat_jobs(ctx: Context, n: int = REPEAT_JOBS_SHOWN) -> DataFrame:
    """The ``n`` jobs completed last that took two or more visits.

    Names are looked up after the cut, so customers are not joined to all jobs.
    """
    repeats = ctx.completed_visits.filter(F.col("num_appointments") >= 2)
    shown = newest_rows(repeats, "completed_at", n, "job_id").select(
        "job_id", "customer_id", "work_status", "num_appointments", "completed_at", "description"
    )
    named = lookup_for_few(shown, ctx.tables["customers"], "customer_id", ("first_name", "last_name"))
    return named.orderBy(F.desc("completed_at"), "job_id").select(
        "job_id",
        customer_name("first_name", "last_name").alias("customer_name"),
        "work_status",
        "num_appointments",
        display("completed_at", ctx.zone).alias("completed_at_central"),
        "description",
    )


def dfo_monthly(ctx: Context) -> DataFrame:
    """DFO share per UTC month; no rows at all when the year has no DFO job."""
    months = ctx.completed.groupBy(month_of("completed_at").alias("month")).agg(
        F.count_if(is_dfo("tags_norm")).alias("dfo_count"), F.count(F.lit(1)).alias("total_count")
    )
    # The window runs over one row per month.
    any_dfo = F.sum("dfo_count").over(Window.partitionBy())
    return (
        months.withColumn("any_dfo", any_dfo)
        .filter("any_dfo > 0")
        .drop("any_dfo")
        .withColumn("dfo_pct", percent("dfo_count", "total_count", 1))
        .orderBy("month")
    )
