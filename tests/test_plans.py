"""What the plans look like, and that frequent keys neither change results nor pile up."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.frames import as_text, dicts
from wrenchlight.operators.filters import key_filter, may_match, scanned_bytes
from wrenchlight.operators.joins import hot_keys, spread_join
from wrenchlight.operators.upsert import latest_per_key, upsert
from wrenchlight.plans import club, employees, leads, quality, revenue
from wrenchlight.plans.context import Context
from wrenchlight.plans.dashboard import AUDITS, BREAKDOWNS, SUMMARIES
from wrenchlight.sources import bucketed
from wrenchlight.sources.tables import Tables
from workload import bridge

STORED = (
    "jobs", "job_employees", "customers", "invoices", "employees", "job_appointments", "invoice_items",
    "estimates", "estimate_options", "estimate_employees", "load_log",
)


def plan_of(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def final_plan(df) -> str:
    """The plan after AQE: the frame is run for it."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    tables = bridge.tables(spark, SF_SMALL)
    for name in STORED:
        tables[name].write.parquet(f"{folder}/{name}")
    return Context(Tables.in_folder(spark, folder), bridge.AS_OF)


@pytest.mark.parametrize("name", sorted({**SUMMARIES, **BREAKDOWNS, **AUDITS}))
def test_no_python_and_no_cross_join(stored, name):
    plan = plan_of({**SUMMARIES, **BREAKDOWNS, **AUDITS}[name](stored))
    for unwanted in ("Python", "Cartesian", "NestedLoop", "ExistingRDD"):
        assert unwanted not in plan


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(quality.dfo_monthly(stored))
    assert "GreaterThanOrEqual(completed_at,2001-01-01 06:00:00.0)" in plan.replace("completed_at#", "completed_at") or "completed_at >= 2001-01-01 06:00:00" in plan
    assert re.search(r"ReadSchema: struct<work_status:string,tags:string,completed_at:timestamp>", plan)


def test_customers_are_not_shuffled_for_the_repeat_list(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(quality.repeat_jobs(stored))
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject" in plan


def test_crews_meet_all_facts_in_one_join(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(employees.crew_metrics(stored))
    assert len(re.findall(r"SortMergeJoin \[job_id\], \[job_id\], Inner", plan)) == 1


@pytest.fixture
def tiny_skew(settings):
    """AQE settings under which a small frame already counts as skewed."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )


def hot_pairs(spark, rows=60_000):
    """A third of all pairs belongs to one job, another third to one employee."""
    third = rows // 3
    i = F.col("id")
    job = F.when(i < third, "hot").otherwise(F.concat(F.lit("job"), (i % 5000).cast("string")))
    person = F.when((i >= third) & (i < 2 * third), "hot").otherwise(F.concat(F.lit("e"), (i % 7000).cast("string")))
    return spark.range(0, rows, 1, 8).select(job.alias("job_id"), person.alias("employee_id"))


def test_a_very_large_crew_is_split(spark, tiny_skew):
    jobs = spark.range(5000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("job"), F.col("id").cast("string"))).alias("job_id"),
        F.lit("complete rated").alias("work_status"),
        F.lit("2001-05-01").cast("timestamp").alias("completed_at"),
        F.lit("call back").alias("tags"),
    )
    pairs = hot_pairs(spark)
    ctx = Context(Tables.of(spark, {"jobs": jobs, "job_employees": pairs}), bridge.AS_OF)
    found = employees.employee_completed(ctx)
    plan = final_plan(employees.crew_metrics(ctx, ("completed",)))
    assert "skew=true" in plan
    wanted = (
        pairs.distinct().join(jobs.select("job_id"), "job_id").groupBy("employee_id").agg(F.count("*").alias("completed_jobs_ytd"))
    )
    assert as_text(found) == as_text(wanted)


def test_hot_keys_and_spread_join(spark):
    many = hot_pairs(spark).distinct()
    assert {r["hot_key"] for r in dicts(hot_keys(many, "job_id"))} == {"hot"}
    assert {r["hot_key"] for r in dicts(hot_keys(many, "employee_id"))} == {"hot"}
    assert dicts(hot_keys(many.filter(F.lit(False)), "job_id")) == []
    one = spark.range(4000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("job"), F.col("id").cast("string"))).alias("job_id"),
        F.col("id").alias("n"),
    )
    with_nulls = many.unionByName(many.limit(50).withColumn("job_id", F.lit(None).cast("string")))
    for how in ("inner", "left"):
        spread = spread_join(with_nulls, one, "job_id", how).select("job_id", "employee_id", "n")
        plain = with_nulls.join(one, "job_id", how).select("job_id", "employee_id", "n")
        assert as_text(spread) == as_text(plain)


def test_spread_join_uses_many_tasks_for_a_hot_key(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    many = hot_pairs(spark).distinct()
    one = spark.createDataFrame([("hot", 1)], "job_id string, n int")
    joined = spread_join(many, one, "job_id").filter("job_id = 'hot'")
    used = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(used) == 4 and max(r["count"] for r in used) < 0.6 * sum(r["count"] for r in used)


def test_lead_by_employee_with_hot_keys(spark):
    pairs = hot_pairs(spark, 30_000).select(F.col("job_id").alias("estimate_id"), "employee_id")
    estimates = pairs.select("estimate_id").distinct().select(
        "estimate_id", F.lit("2001-03-01").cast("timestamp").alias("created_at")
    )
    options = estimates.select(
        F.col("estimate_id").alias("option_id"),
        "estimate_id",
        F.when(F.crc32("estimate_id") % 2 == 0, "approved").otherwise("declined").alias("approval_status"),
    )
    staff = pairs.select("employee_id").distinct().select("employee_id", F.concat(F.lit("N"), F.crc32("employee_id") % 50).alias("first_name"))
    ctx = Context(
        Tables.of(spark, {"estimates": estimates, "estimate_options": options, "estimate_employees": pairs, "employees": staff}),
        bridge.AS_OF,
    )
    found = leads.lead_by_employee(ctx).select("employee_name", "estimates", "won", "lost")
    wanted = (
        pairs.distinct().join(options, "estimate_id").join(staff, "employee_id").groupBy(F.col("first_name").alias("employee_name"))
        .agg(
            F.count_distinct("estimate_id").alias("estimates"),
            F.count_if(F.col("approval_status") == "approved").alias("won"),
            F.count_if(F.col("approval_status") == "declined").alias("lost"),
        )
    )
    assert as_text(found) == as_text(wanted)


def test_copies_of_a_key_are_cut_before_the_shuffle(spark):
    events = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v")
    )
    newest = latest_per_key(events, ["k"], newest=["v"])
    plan = plan_of(newest)
    assert re.search(r"WindowGroupLimit[^\n]*Final", plan) and re.search(r"WindowGroupLimit[^\n]*Partial", plan)
    wanted = events.groupBy("k").agg(F.max("v").alias("v"))
    assert as_text(newest) == as_text(wanted)


def test_small_batches_do_not_shuffle_the_target(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    target = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"))
    batch = spark.range(5).select(F.col("id").cast("string").alias("k"), F.lit("new").alias("v"))
    small = plan_of(upsert(target, batch, ["k"], small_batch=True))
    large = plan_of(upsert(target, batch, ["k"], small_batch=False))
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small
    assert "SortMergeJoin" in large and "BroadcastHashJoin" not in large


def test_club_items_are_reduced_before_the_join(stored):
    plan = plan_of(club.club_item_jobs(stored, stored.year_start))
    join = plan.index("Join")
    assert plan.index("HashAggregate(keys=[invoice_id, item_job_id]") > join


def test_cut_to_the_year_before_reducing(stored):
    """The large child tables meet a semi-join below their first aggregation, which is the deepest one."""
    for frame in (stored.completed_visits, stored.outcomes, club.club_item_jobs(stored, stored.year_start)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan[plan.rindex("Aggregate"):]
    plan = leads.lead_by_employee(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_crews_are_made_distinct_behind_the_join(stored):
    plan = employees.crew_metrics(stored)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    scan = plan.index("employee_id", join)
    assert "Aggregate" in plan[:join] and "Aggregate" not in plan[join : scan]
    # The crew side is the first child of the join: a scan with a filter.
    crew = plan[join:].split("\n")[1:4]
    assert any("Relation" in line for line in crew) and not any("Aggregate" in line for line in crew)


def test_key_filter(spark):
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    keys = keys.unionByName(spark.createDataFrame([(None,)], "key string"))
    rows = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    found = may_match(rows, keys, "key")
    assert found.join(keys, "key", "left_semi").count() == 1000
    assert 1000 <= found.count() < 1100 and found.filter("key is null").count() == 0
    assert may_match(rows, keys.filter("false"), "key").count() == 0
    assert key_filter(keys, "key").count() <= 1000
    assert "BroadcastHashJoin" in plan_of(found)


@pytest.mark.parametrize("plan", [employees.employee_cards, revenue.revenue_breakdown, revenue.average_ticket, quality.quality_summary, leads.lead_by_source])
def test_results_are_the_same_with_the_filter(spark, stored, plan):
    cut = Context(stored.tables, bridge.AS_OF, filter_from=0)
    assert as_text(plan(cut)) == as_text(plan(stored))


def test_filter_stands_below_the_shuffle_of_large_tables(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    assert scanned_bytes(stored.tables["job_employees"]) > 0
    large = Context(stored.tables, bridge.AS_OF, filter_from=0)
    for frame in (large.crew, large.job_categories, large.install_jobs):
        plan = plan_of(frame)
        assert "LeftSemi, BuildRight" in plan and "bit_or" in plan
    assert "bit_or" not in plan_of(stored.crew)


@pytest.fixture(scope="module")
def by_job(spark, stored, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("by-job"))
    yield root, Context(bucketed.write_by_job(stored.tables, root, 4), bridge.AS_OF)
    bucketed.forget(spark, root)


def test_no_shuffle_below_joins_by_job(by_job, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    ctx = by_job[1]
    for frame in (ctx.billed_by_category, ctx.completed_visits, ctx.billed.join(ctx.install_jobs, "job_id", "left_anti"), ctx.crew.join(ctx.completed, "job_id").distinct()):
        plan = plan_of(frame)
        join = plan.index("SortMergeJoin")
        assert "Exchange" not in plan[join:], plan
    # Facts of several kinds are stacked and dealt out, a few numbers for each job of the year; crews stay where they are.
    plan = plan_of(employees.crew_metrics(ctx))
    below = plan[plan.index("SortMergeJoin"):]
    assert "job_employees" in below and "Exchange" not in below[: below.index("FileScan")]


def test_bucketed_copies_give_the_same_results(spark, stored, by_job):
    root, ctx = by_job
    for plan in (employees.employee_cards, revenue.revenue_breakdown, quality.quality_summary):
        assert as_text(plan(ctx)) == as_text(plan(stored))
    bucketed.forget(spark, root)
    again = Context(bucketed.read_by_job(spark, root, stored.tables, 4), bridge.AS_OF)
    assert as_text(revenue.average_ticket(again)) == as_text(revenue.average_ticket(stored))
    assert "Bucketed: true" in again.billed_by_category._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_a_table_with_a_hot_job_is_not_bucketed(spark, tmp_path):
    pairs = hot_pairs(spark, 9000)
    tables = Tables.of(spark, {"job_employees": pairs})
    found = bucketed.write_by_job(tables, str(tmp_path / "hot"), 8)
    assert "Bucketed: true" not in plan_of(found["job_employees"]) and found["job_employees"].count() == 9000
    bucketed.forget(spark, str(tmp_path / "hot"))


def test_year_and_months_of_the_club_come_from_one_aggregation(spark, stored, tmp_path):
    kept = Context(stored.tables, bridge.AS_OF)
    kept.keep("club_months", club.club_months(stored), str(tmp_path))
    for plan in (club.club_summary, club.club_monthly):
        text = plan_of(plan(kept))
        assert text.count("FileScan") == 1 and "Join" not in text
        assert as_text(plan(kept)) == as_text(plan(stored))
    assert kept.__dict__["club_months"].count() <= 12
    assert as_text(club.club_summary(kept, strict=True)) == as_text(club.club_summary(stored, strict=True))
