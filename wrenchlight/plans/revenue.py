"""Billed revenue and average ticket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.functions.labels import at_least, is_install_category
from wrenchlight.functions.numbers import clamp_percent, currency, dollars, percent, ratio
from wrenchlight.operators.reports import integer_shares
from wrenchlight.plans.context import Context

# Fixed value: dollars per invoice to reach.
AVERAGE_TICKET_TARGET = 450.0


def revenue_total(ctx: Context) -> DataFrame:
    total = ctx.billed.agg(dollars(F.sum("cents")).alias("total_revenue_ytd"))
    return total.withColumn("total_revenue_ytd_display", currency("total_revenue_ytd"))


def revenue_breakdown(ctx: Context) -> DataFrame:
    """Revenue per category, with whole percentages that add up to 100.

    At most eight rows, so the windows without partition key are cheap.
    """
    everything = Window.partitionBy()
    revenue = ctx.billed_by_category.select("category", dollars("cents").alias("revenue"))
    measured = revenue.withColumns(
        {"total": F.sum("revenue").over(everything), "largest": F.max("revenue").over(everything)}
    ).withColumn("raw_share", percent("revenue", "total"))
    shared = integer_shares(measured, "raw_share", "share", F.desc("revenue"), F.col("category"))
    return shared.orderBy(F.desc("revenue"), "category").select(
        "category",
        "revenue",
        currency("revenue").alias("revenue_display"),
        F.col("share").cast("double").alias("pct_of_total"),
        F.concat(F.col("share").cast("string"), F.lit("%")).alias("pct_of_total_display"),
        clamp_percent(percent("revenue", "largest")).alias("pct_of_max"),
    )


def average_ticket(ctx: Context) -> DataFrame:
    """One row: dollars per invoice over all, service and install invoices."""
    install = is_install_category("category")
    parts = {"": F.lit(True), "service_": ~install, "install_": install}
    sums = []
    for part, chosen in parts.items():
        sums.append(F.coalesce(F.sum(F.when(chosen, F.col("cents"))), F.lit(0)).alias(f"{part}cents"))
        count = F.sum(F.when(chosen, F.col("invoice_count")))
        sums.append(F.coalesce(count, F.lit(0)).alias(f"{part}invoice_count"))
    totals = ctx.billed_by_category.agg(*sums)
    columns = [F.lit(AVERAGE_TICKET_TARGET).alias("avg_ticket_target")]
    for part in parts:
        name = f"{part}avg_ticket" if part else "average_ticket"
        value = ratio(dollars(f"{part}cents"), F.col(f"{part}invoice_count"))
        columns += [
            value.alias(name),
            currency(value).alias(f"{name}_display"),
            at_least(value, AVERAGE_TICKET_TARGET).alias(f"{name}_status"),
            F.col(f"{part}invoice_count"),
        ]
    return totals.select(*columns)
