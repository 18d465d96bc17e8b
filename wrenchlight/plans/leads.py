"""What became of the estimates of the year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.numbers import percent, ratio
from wrenchlight.functions.text import blank_to_null, full_name, looks_like_raw_id, or_default
from wrenchlight.functions.times import month_of
from wrenchlight.operators.filters import near
from wrenchlight.operators.joins import spread_join
from wrenchlight.plans.context import Context

UNASSIGNED = "Unassigned"


def _outcome_counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == name).alias(name) for name in ("won", "lost", "pending")]


def _rated(grouped: DataFrame, digits: int = 1) -> DataFrame:
    return grouped.withColumn("win_rate", percent(F.col("won"), F.col("won") + F.col("lost"), digits))


def lead_summary(ctx: Context) -> DataFrame:
    """One row. Calls are the completed jobs of the year, for want of a table of calls."""
    estimates = ctx.outcomes.agg(F.count(F.lit(1)).alias("created"), *_outcome_counts())
    calls = ctx.completed.agg(F.count(F.lit(1)).alias("calls"))
    names = ("created", "won", "lost", "pending", "calls")
    # Two frames of one row each, stacked and added up.
    both = estimates.unionByName(calls, allowMissingColumns=True)
    totals = both.agg(*[F.sum(name).alias(name) for name in names])
    return _rated(totals).select(
        F.col("created").alias("estimates_created_ytd"),
        F.col("won").alias("estimates_won_ytd"),
        F.col("lost").alias("estimates_lost_ytd"),
        F.col("pending").alias("estimates_pending_ytd"),
        F.col("win_rate").alias("win_rate_ytd"),
        F.col("calls").alias("calls_ytd"),
        ratio("created", "calls", 3).alias("estimate_to_call_ratio"),
    )


def _by(outcomes: DataFrame, label: Column, name: str) -> DataFrame:
    grouped = outcomes.groupBy(label.alias(name)).agg(
        F.count(F.lit(1)).alias("estimates"), *_outcome_counts()
    )
    return _rated(grouped)


def lead_by_month(ctx: Context) -> DataFrame:
    return _by(ctx.outcomes, month_of("created_at"), "month").orderBy("month")


def lead_by_source(ctx: Context) -> DataFrame:
    grouped = _by(ctx.outcomes, or_default("lead_source", "Unknown"), "lead_source")
    return grouped.orderBy(F.desc("estimates"), "lead_source")


def lead_by_employee(ctx: Context, distinct: bool = False) -> DataFrame:
    """Outcomes per employee name; every employee assigned to an estimate is credited.

    The name comes from the employees, else from the assignment, else "Unassigned".
    ``estimates`` counts an estimate once per name. The outcomes count
    assignments, so two employees of one name on one estimate count twice, unless
    ``distinct``.
    """
    stored = ctx.tables["estimate_employees"].filter(F.col("estimate_id").isNotNull())
    given_name = full_name("first_name", "last_name").alias("given_name")
    outcomes = ctx.outcomes.select("estimate_id", "outcome")
    keys = ctx.estimates_this_year.select("estimate_id")
    recent = near(stored, keys, "estimate_id", ctx.filter_from).join(keys, "estimate_id", "left_semi")
    assigned = recent.select("estimate_id", "employee_id", given_name).distinct()
    rated = spread_join(assigned, outcomes, "estimate_id", hot=ctx.tables.hot_parents("estimate_employees"))
    names = ctx.employees.select("employee_id", "employee_name")
    named = rated.join(names, "employee_id", "left").withColumn(
        "employee_name",
        F.coalesce(blank_to_null("employee_name"), blank_to_null("given_name"), F.lit(UNASSIGNED)),
    )
    shown = F.when(looks_like_raw_id("employee_name"), UNASSIGNED).otherwise(F.col("employee_name"))
    # Per name and estimate first: the distinct count becomes a count of rows.
    per_estimate = named.groupBy(shown.alias("employee_name"), "estimate_id", "outcome").agg(
        F.count(F.lit(1)).alias("assignments")
    )
    credit = F.lit(1) if distinct else F.col("assignments")
    grouped = per_estimate.groupBy("employee_name").agg(
        F.count(F.lit(1)).alias("estimates"),
        *[
            F.coalesce(F.sum(F.when(F.col("outcome") == name, credit)), F.lit(0)).cast("bigint").alias(name)
            for name in ("won", "lost", "pending")
        ],
    )
    return _rated(grouped).orderBy(F.desc("estimates"), "employee_name")
