"""Data audits: the club signal recounted row by row, and the state of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions import text
from wrenchlight.functions.labels import COMPLETED_STATES
from wrenchlight.functions.numbers import percent
from wrenchlight.operators.reports import newest_rows, row_counts
from wrenchlight.plans.club import SOURCES, club_item_jobs, with_club_sources
from wrenchlight.plans.context import Context
from wrenchlight.sources.tables import Tables


def _completed_in_utc_year(ctx: Context) -> DataFrame:
    """Completed jobs as the audit sees them: states are trimmed, the year is the UTC year."""
    done = text.clean("work_status").isin(*COMPLETED_STATES)
    return ctx.tables["jobs"].filter(done & (F.col("completed_at") >= ctx.utc_year_start))


def club_audit(ctx: Context) -> DataFrame:
    """Club signal by source over service calls, with the wider list of install words."""
    calls = _completed_in_utc_year(ctx).select(
        "job_id", "description", text.normalize_tags_distinct("tags").alias("tags_norm")
    )
    service = calls.filter(~text.contains_any("tags_norm", text.AUDIT_INSTALL_KEYWORDS))
    sourced = with_club_sources(service, club_item_jobs(ctx, ctx.utc_year_start))
    totals = sourced.agg(
        F.count(F.lit(1)).alias("service_calls_ytd"),
        *[F.count_if(f"from_{source}").alias(f"club_calls_from_{source}") for source in SOURCES],
    )
    shares = [
        percent(f"club_calls_from_{source}", "service_calls_ytd", 2).alias(f"pct_from_{source}")
        for source in SOURCES
    ]
    return totals.select("*", *shares, F.lit(", ".join(text.CLUB_KEYWORDS)).alias("club_keywords"))


def job_baseline(ctx: Context) -> DataFrame:
    """Jobs in all, completed this UTC year, and without tags."""
    done = text.clean("work_status").isin(*COMPLETED_STATES)
    start = F.concat(F.date_format(ctx.utc_year_start, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return ctx.tables["jobs"].agg(
        F.count(F.lit(1)).alias("jobs_total"),
        F.count_if(done & (F.col("completed_at") >= ctx.utc_year_start)).alias("completed_jobs_ytd_total"),
        F.count_if(F.col("tags").isNull()).alias("null_tags_all_time"),
        F.count_if(text.is_blank("tags")).alias("empty_tags_all_time"),
    ).withColumn("ytd_start_utc", start)


def table_counts(tables: Tables, names: tuple[str, ...]) -> DataFrame:
    return row_counts({name: tables[name] for name in names})


def table_sample(tables: Tables, name: str, by: str, n: int = 10, *tie_breakers: str) -> DataFrame:
    """The newest rows of a table by any of its columns."""
    return newest_rows(tables[name], by, n, *tie_breakers)
