"""Estimates of the year and the state of all options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.labels import option_bucket
from wrenchlight.functions.numbers import currency, dollars
from wrenchlight.plans.context import Context


def estimates_count(ctx: Context) -> DataFrame:
    return ctx.estimates_this_year.agg(F.count(F.lit(1)).alias("estimates_ytd_count"))


def option_status_breakdown(ctx: Context) -> DataFrame:
    """Options of all time per state. Amounts are stored in cents and shown in dollars."""
    bucket = option_bucket("approval_status", "status").alias("bucket")
    buckets = ctx.tables["estimate_options"].groupBy(bucket).agg(
        F.count(F.lit(1)).alias("option_count"), dollars(F.sum("total_amount")).alias("total_amount")
    )
    shown = buckets.withColumn("total_amount_display", currency("total_amount"))
    return shown.orderBy(F.desc("option_count"), "bucket")
