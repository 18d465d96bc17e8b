"""Club membership on service calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.labels import at_least
from wrenchlight.functions.numbers import fixed_point, percent
from wrenchlight.functions.text import CLUB_KEYWORDS, clean, has_club_word, is_blank
from wrenchlight.functions.times import month_of
from wrenchlight.plans.context import Context

# Fixed value: percent of service calls that should be club calls.
CLUB_TARGET = 50.0

SOURCES = ("tags", "description", "invoice_items")


def club_item_jobs(ctx: Context, since: Column) -> DataFrame:
    """(job_id) with a club item on an invoice dated ``since`` or later, of any state.

    Items are filtered by name, cut to those invoices and reduced to distinct pairs before the join, so
    an invoice with very many lines is one row.
    """
    invoices = ctx.tables["invoices"].filter(F.col("invoice_date") >= since)
    items = ctx.tables["invoice_items"].filter(has_club_word("name"))
    items = items.join(invoices.select("invoice_id"), "invoice_id", "left_semi")
    pairs = items.select("invoice_id", F.col("job_id").alias("item_job_id")).distinct()
    joined = pairs.join(invoices.select("invoice_id", "job_id"), "invoice_id")
    jobs = joined.select(F.coalesce("job_id", "item_job_id").alias("job_id"))
    return jobs.filter(~is_blank("job_id")).distinct()


def with_club_sources(calls: DataFrame, item_jobs: DataFrame | None) -> DataFrame:
    """Adds one flag per source of the club signal to ``calls``.

    ``calls`` needs job_id, tags_norm and description; ``item_jobs`` None means
    that invoice items never signal.
    """
    flagged = calls.withColumns(
        {"from_tags": has_club_word("tags_norm"), "from_description": has_club_word(clean("description"))}
    )
    if item_jobs is None:
        return flagged.withColumn("from_invoice_items", F.lit(False))
    marked = item_jobs.withColumn("from_invoice_items", F.lit(True))
    joined = flagged.join(marked, "job_id", "left")
    return joined.withColumn("from_invoice_items", F.coalesce("from_invoice_items", F.lit(False)))


def _service_calls(ctx: Context, strict: bool) -> DataFrame:
    """Completed jobs of the year without "install" in their tags, with a club flag."""
    calls = ctx.completed.filter(~F.contains("tags_norm", F.lit("install")) & ~is_blank("job_id"))
    narrow = calls.select("job_id", "tags_norm", "description", "completed_at")
    item_jobs = None if strict else club_item_jobs(ctx, ctx.year_start)
    sourced = with_club_sources(narrow, item_jobs)
    is_club = F.col("from_tags") | F.col("from_description") | F.col("from_invoice_items")
    return sourced.withColumn("is_club", is_club)


def club_months(ctx: Context, strict: bool = False) -> DataFrame:
    """(month, calls, club_calls, from_...): the counts that both the year's and the months' figures are added up from, a dozen rows."""
    kept = ctx.__dict__.get("club_months")
    if kept is not None and not strict:
        return kept
    return _service_calls(ctx, strict).groupBy(month_of("completed_at").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("is_club").alias("club_calls"),
        *[F.count_if(f"from_{source}").alias(f"from_{source}") for source in SOURCES],
    )


def club_summary(ctx: Context, strict: bool = False) -> DataFrame:
    """One row: share of club calls, and how many each source finds (calls may count for several).

    strict: leave the invoice items out, as the published dashboard in effect does.
    """
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    totals = club_months(ctx, strict).agg(
        total("calls").alias("eligible_service_calls_ytd"),
        total("club_calls").alias("club_calls_ytd"),
        *[total(f"from_{source}").alias(f"club_calls_from_{source}") for source in SOURCES],
    )
    share = percent("club_calls_ytd", "eligible_service_calls_ytd")
    return totals.select(
        F.bround(share, 2).alias("club_conversion_pct"),
        fixed_point(share, 2, "%").alias("club_conversion_pct_display"),
        at_least(share, CLUB_TARGET).alias("club_conversion_status"),
        F.lit(CLUB_TARGET).alias("club_conversion_target"),
        "eligible_service_calls_ytd",
        "club_calls_ytd",
        (F.col("eligible_service_calls_ytd") - F.col("club_calls_ytd")).alias("nonclub_service_calls_ytd"),
        *[F.col(f"club_calls_from_{source}") for source in SOURCES],
        *[
            percent(f"club_calls_from_{source}", "eligible_service_calls_ytd", 2).alias(f"pct_from_{source}")
            for source in SOURCES
        ],
        F.lit(", ".join(CLUB_KEYWORDS)).alias("club_keywords"),
    )


def club_monthly(ctx: Context, strict: bool = False) -> DataFrame:
    months = club_months(ctx, strict).withColumnRenamed("calls", "service_calls")
    share = percent("club_calls", "service_calls")
    return months.orderBy("month").select(
        "month",
        "service_calls",
        "club_calls",
        F.bround(share, 2).alias("club_conversion_pct"),
        fixed_point(share, 2, "%").alias("club_conversion_pct_display"),
    )
