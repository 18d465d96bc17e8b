"""When the data was loaded last, and when it may be loaded again."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.times import BUSINESS_ZONE, display_with_zone, parse_time
from wrenchlight.plans.context import Context

# The facts kept about a load, and the time to wait between two loads.
LOAD_KEYS = ("last_refresh", "last_window_start", "last_window_end")
MIN_INTERVAL = timedelta(hours=1)


def latest_facts(load_log: DataFrame) -> DataFrame:
    """(key, value): the newest value of every key."""
    return load_log.groupBy("key").agg(F.max_by("value", "recorded_at").alias("value"))


def load_facts(ctx: Context) -> DataFrame:
    """The latest refresh and window, by key."""
    facts = latest_facts(ctx.tables["load_log"])
    return facts.filter(F.col("key").isin(*LOAD_KEYS)).orderBy("key")


def _last_refresh(facts: DataFrame) -> DataFrame:
    """One row (value, loaded_at), both NULL before the first load."""
    value = F.max(F.when(F.col("key") == "last_refresh", F.nullif("value", F.lit("")))).alias("value")
    return facts.agg(value).withColumn("loaded_at", parse_time("value"))


def refresh_due(facts: DataFrame, as_of: Column, min_interval: timedelta = MIN_INTERVAL) -> DataFrame:
    """One row (due): is the last load at least ``min_interval`` ago, unknown or missing?"""
    wait = F.make_dt_interval(secs=F.lit(min_interval.total_seconds()))
    due = F.coalesce(as_of >= F.col("loaded_at") + wait, F.lit(True))
    return _last_refresh(facts).select(due.alias("due"))


def freshness(ctx: Context, min_interval: timedelta = MIN_INTERVAL) -> DataFrame:
    """One row: may a refresh run now, when next, and when was the last."""
    last = _last_refresh(latest_facts(ctx.tables["load_log"]))
    loaded = F.col("loaded_at")
    upcoming = loaded + F.make_dt_interval(secs=F.lit(min_interval.total_seconds()))
    zone = ctx.zone or BUSINESS_ZONE
    shown = F.when(F.col("value").isNull(), "No data yet").when(loaded.isNull(), "Unknown")
    return last.select(
        F.coalesce(ctx.as_of >= upcoming, F.lit(True)).alias("can_refresh"),
        F.when(loaded.isNull(), "Now").otherwise(display_with_zone(upcoming, zone)).alias("next_refresh"),
        shown.otherwise(display_with_zone(loaded, zone)).alias("last_refresh_display"),
    )
