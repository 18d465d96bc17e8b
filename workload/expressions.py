"""Column functions and report operators over whole given tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlight.functions import labels, numbers, text, times
from wrenchlight.operators.flatten import jobs_wanting_details
from wrenchlight.operators.reports import integer_shares, newest_rows
from wrenchlight.plans.audit import table_counts
from wrenchlight.plans.context import crew_as_employees
from wrenchlight.schemas import schema_listing
from wrenchlight.session import prepare
from wrenchlight.sources.landing import updated_within
from wrenchlight.sources.tables import Tables, read_parquet_if_present
from workload import oracle
from workload.bridge import Bridge, context, given, tables

COUNTED = (
    "jobs", "job_employees", "customers", "invoices", "employees", "job_appointments",
    "invoice_items", "estimates", "estimate_options", "estimate_employees", "pricebook_services",
)


def _messy_tags() -> Column:
    """Tags with odd case, blanks, empty entries and repeats; NULL for every ninth order."""
    word = F.col("o_orderpriority")
    messy = F.concat(F.lit(" "), F.upper(word), F.lit(" ,, "), F.lower(word), F.lit(",Residential , "), F.lower(word))
    return F.when(F.col("o_orderkey") % 9 != 0, messy)


_MESSY_SQL = (
    "CASE WHEN o_orderkey % 9 <> 0 THEN ' ' || upper(o_orderpriority) || ' ,, ' || lower(o_orderpriority) "
    "|| ',Residential , ' || lower(o_orderpriority) END"
)


def tag_normalize(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(prepare(spark), folder, "orders")
    return orders.select("o_orderkey", text.normalize_tags(_messy_tags()).alias("tags_norm"))


def tag_normalize_distinct(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(prepare(spark), folder, "orders")
    return orders.select("o_orderkey", text.normalize_tags_distinct(_messy_tags()).alias("tags_norm"))


def category_map(spark: SparkSession, folder: str) -> DataFrame:
    category = labels.job_category("tags")
    return tables(spark, folder)["jobs"].select(
        "job_id", category.alias("category"), labels.is_install_category(category).alias("is_install")
    )


def tag_predicates(spark: SparkSession, folder: str) -> DataFrame:
    return tables(spark, folder)["jobs"].select(
        "job_id",
        text.is_dfo("tags").alias("is_dfo"),
        text.is_callback("tags").alias("is_callback"),
        text.tag_has("tags", "demand service").alias("has_phrase"),
        text.tag_has("tags", "construct").alias("has_part_of_word"),
        text.contains_any("tags", text.AUDIT_INSTALL_KEYWORDS).alias("has_install_word"),
    )


def club_words_in_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search over whole texts."""
    documents = prepare(spark).read.schema("doc_id bigint, text string").parquet(f"{folder}/documents.parquet")
    return documents.select("doc_id", text.has_club_word("text").alias("has_club_word"))


def status_levels(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(prepare(spark), folder, "orders")
    level = (F.col("o_orderkey") % 13).cast("double")
    return orders.select(
        "o_orderkey",
        labels.at_least(F.col("o_totalprice") / 500, 450.0).alias("ticket_status"),
        labels.below_levels(level, 5, 10).alias("dfo_status"),
        labels.up_to_levels(level, 5, 10).alias("callback_status"),
    )


def currency_display(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(prepare(spark), folder, "orders")
    price, cents = F.col("o_totalprice"), numbers.to_cents(F.col("o_totalprice") * 100)
    return orders.select(
        "o_orderkey",
        numbers.currency(price).alias("display"),
        numbers.currency(F.floor(price) + 0.5).alias("half_display"),
        numbers.dollars(cents).alias("dollars"),
        numbers.currency(F.when(F.col("o_orderkey") % 2 == 0, price)).alias("gaps_display"),
    )


def ratio_display(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios with zero denominators, percent and hour texts, clamping."""
    lines = given(prepare(spark), folder, "lineitem")
    sums = lines.groupBy("l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("whole"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint"))).alias("part"),
    )
    base = sums.select("l_suppkey", "part", F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("whole")).alias("whole"))
    share = numbers.percent("part", "whole")
    return base.select(
        "l_suppkey",
        numbers.ratio("part", "whole", 3).alias("ratio3"),
        numbers.percent("part", "whole", 2).alias("pct2"),
        numbers.fixed_point(share, 1, "%").alias("pct_display"),
        numbers.fixed_point(F.col("part") / 60, 1, " hrs").alias("hours_display"),
        numbers.clamp_percent(share * 3 - 50).alias("clamped"),
    )


def option_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    options = tables(spark, folder)["estimate_options"]
    return options.select(
        "option_id",
        labels.outcome_name(labels.outcome_weight("approval_status", "status")).alias("outcome"),
        labels.option_bucket("approval_status", "status").alias("bucket"),
    )


def best_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Heaviest outcome per estimate."""
    weight = labels.outcome_weight("approval_status", "status")
    options = tables(spark, folder)["estimate_options"]
    best = options.groupBy("estimate_id").agg(F.max(weight).alias("weight"))
    return best.select("estimate_id", labels.outcome_name("weight").alias("outcome"))


def time_displays(spark: SparkSession, folder: str) -> DataFrame:
    """Central display, month and day of every order date, hour by hour."""
    orders = given(prepare(spark), folder, "orders")
    hours = (F.col("o_orderkey") % 24).cast("int")
    ts = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=hours))
    return orders.select(
        "o_orderkey",
        times.display(ts).alias("central"),
        times.display_with_zone(ts).alias("central_with_zone"),
        times.month_of(ts).alias("month"),
        times.day_of(ts).cast("string").alias("day"),
        F.date_format(times.year_start(ts), "yyyy-MM-dd HH:mm").alias("year_start"),
    )


def time_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """ISO texts of five shapes, and bad ones."""
    ts = F.date_trunc("second", F.col("ts"))
    shape = F.col("event_id") % 7
    written = (
        F.when(shape == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(shape == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(shape == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(shape == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.250-06:00'"))
        .when(shape == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .when(shape == 5, "not a time")
    )
    parsed = times.parse_time(written)
    return given(prepare(spark), folder, "events").select(
        "event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSS").alias("parsed")
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    customers = tables(spark, folder)["customers"]
    number = F.col("customer_id").cast("bigint")
    first = F.when(number % 4 != 0, F.concat(F.lit(" "), "first_name", F.lit(" ")))
    last = F.when(number % 3 != 0, F.col("last_name")).when(number % 2 == 0, F.lit("  "))
    raw = F.when(number % 5 == 0, F.concat(F.lit("pro_"), F.md5("customer_id"))).otherwise(F.col("first_name"))
    return customers.select(
        "customer_id",
        text.customer_name(first, last).alias("customer_name"),
        text.employee_name(first, last).alias("employee_name"),
        text.or_default(last, "Technician").alias("role"),
        text.looks_like_raw_id(raw).alias("raw_id"),
    )


def share_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """Whole percentages per kind of line, adding up to 100."""
    lines = given(prepare(spark), folder, "lineitem")
    grouped = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    raw = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100.0
    shared = integer_shares(
        grouped.withColumn("raw", raw), "raw", "share", F.desc("n"), "l_returnflag", "l_linestatus"
    )
    return shared.select("l_returnflag", "l_linestatus", "n", "share")


def table_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of eleven tables, one of them absent."""
    return table_counts(tables(spark, folder), COUNTED)


def latest_n(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 newest events, as a report."""
    events = given(prepare(spark), folder, "events").select("event_id", "user_id", "event_type", "value")
    return newest_rows(events, "event_id", 100)


def newest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 jobs completed last; jobs not completed come after all others."""
    jobs = newest_rows(tables(spark, folder)["jobs"], "completed_at", 10, "job_id")
    return jobs.select("job_id", "work_status", F.date_format("completed_at", "yyyy-MM-dd").alias("completed"))


def semi_join_ytd(spark: SparkSession, folder: str) -> DataFrame:
    """Options of this year's estimates."""
    ctx = context(spark, folder)
    wanted = ctx.estimates_this_year.select("estimate_id")
    options = ctx.tables["estimate_options"].join(wanted, "estimate_id", "left_semi")
    return options.select("option_id", "estimate_id", "total_amount")


def employee_dim_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Employees out of the job crews, as if there were no employees table."""
    source = Bridge(prepare(spark), folder)
    found = crew_as_employees(Tables(spark, lambda name: None if name == "employees" else source(name)))
    return found.select("employee_id", "employee_name", "role")


def appointment_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct appointments of every job that has any."""
    return context(spark, folder).appointment_counts


def incremental_window(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs changed in the 60 days before the load."""
    ctx = context(spark, folder)
    recent = updated_within(ctx.tables["jobs"], ctx.as_of, 60)
    return recent.select("job_id", "work_status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def details_wanted(spark: SparkSession, folder: str) -> DataFrame:
    """Completed jobs changed in the 45 days before the load."""
    ctx = context(spark, folder)
    return jobs_wanting_details(ctx.tables["jobs"], ctx.as_of - F.expr("interval 45 days"))


# Given tables and columns that are asked for; ``calls`` does not exist, nor does the last column.
ASKED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), "lineitem": ("l_orderkey", "l_linenumber", "l_quantity"),
    "events": ("event_id", "ts", "value", "props"), "documents": ("doc_id", "text", "lang", "author"), "calls": ("call_id",),
}


def table_presence(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, present, column_name, type, filled): which tables and columns there are, with their types and how many values they hold."""
    tables = {name: read_parquet_if_present(prepare(spark), f"{folder}/{name}.parquet") for name in ASKED}
    listing = schema_listing(spark, {name: frame for name, frame in tables.items() if frame is not None})
    asked = spark.createDataFrame([(name, name in tables and tables[name] is not None, c) for name, columns in ASKED.items() for c in columns], "table_name string, present boolean, column_name string")
    counts = [
        frame.agg(*[F.count(c).alias(c) for c in ASKED[name] if c in frame.columns]).unpivot([], [c for c in ASKED[name] if c in frame.columns], "column", "filled").withColumn("table", F.lit(name))
        for name, frame in tables.items() if frame is not None
    ]
    known = listing.join(reduce(DataFrame.unionByName, counts), ["table", "column"])
    joined = asked.join(known, (asked["table_name"] == known["table"]) & (asked["column_name"] == known["column"]), "left")
    return joined.select("table_name", "present", "column_name", "type", "filled")


QUERIES = {
    f.__name__: f
    for f in (
        tag_normalize, tag_normalize_distinct, category_map, tag_predicates, club_words_in_texts,
        status_levels, currency_display, ratio_display, option_outcomes, best_outcome, time_displays,
        time_parsing, names, share_rounding, table_audit, latest_n, newest_jobs, semi_join_ytd,
        employee_dim_fallback, appointment_counts, incremental_window, details_wanted, table_presence,
    )
}

_TS = "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24) END"
_SECOND = "date_trunc('second', ts)"
_FIRST = "CASE WHEN c_custkey % 4 <> 0 THEN ' ' || split_part(c_name, '#', 1) || ' ' END"
_LAST = "CASE WHEN c_custkey % 3 <> 0 THEN split_part(c_name, '#', 2) WHEN c_custkey % 2 = 0 THEN '  ' END"

SQL = {
    "tag_normalize": f"""SELECT o_orderkey, array_to_string({oracle.norm_tags(f'({_MESSY_SQL})')}, ',') AS tags_norm
        FROM orders""",
    # The messy tags repeat one word at fixed places, so their distinct form can be written down.
    "tag_normalize_distinct": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0
        THEN lower(o_orderpriority) || '|residential' ELSE '' END AS tags_norm FROM orders""",
    "category_map": oracle.sql(
        """SELECT job_id, category, contains(category, 'Install') AS is_install FROM ("""
        f"""SELECT job_id, {oracle.category('tags_norm')} AS category FROM jobs_norm)"""
    ),
    "tag_predicates": oracle.sql(
        f"""SELECT job_id, {oracle.tag_has('tags_norm', 'dfo')} AS is_dfo,
              {oracle.any_tag('tags_norm', text.CALLBACK_TAGS)} AS is_callback,
              contains(tags_norm, 'demand service') AS has_phrase, FALSE AS has_part_of_word,
              {oracle.any_word('tags_norm', text.AUDIT_INSTALL_KEYWORDS)} AS has_install_word
            FROM jobs_norm"""
    ),
    "club_words_in_texts": f"SELECT doc_id, {oracle.any_word('text', text.CLUB_KEYWORDS)} AS has_club_word FROM documents",
    "status_levels": """SELECT o_orderkey,
          CASE WHEN o_totalprice / 500 >= 450 THEN 'success' ELSE 'danger' END AS ticket_status,
          CASE WHEN o_orderkey % 13 < 5 THEN 'success' WHEN o_orderkey % 13 < 10 THEN 'warning'
               ELSE 'danger' END AS dfo_status,
          CASE WHEN o_orderkey % 13 <= 5 THEN 'success' WHEN o_orderkey % 13 <= 10 THEN 'warning'
               ELSE 'danger' END AS callback_status FROM orders""",
    "currency_display": f"""SELECT o_orderkey, {oracle.currency('o_totalprice')} AS display,
          {oracle.currency('(floor(o_totalprice) + 0.5::DOUBLE)')} AS half_display,
          round(o_totalprice * 100)::BIGINT::DOUBLE / 100.0::DOUBLE AS dollars,
          CASE WHEN o_orderkey % 2 = 0 THEN {oracle.currency('o_totalprice')} ELSE '$0' END AS gaps_display
        FROM orders""",
    "ratio_display": f"""WITH sums AS (SELECT l_suppkey, CASE WHEN l_suppkey % 5 = 0 THEN 0
            ELSE sum(l_quantity::BIGINT)::BIGINT END AS whole,
          (sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'))::BIGINT AS part FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, {oracle.ratio('part', 'whole', 3)} AS ratio3, {oracle.pct('part', 'whole', 2)} AS pct2,
          {oracle.fixed(oracle.pct('part', 'whole'), 1, '%')} AS pct_display,
          {oracle.fixed('part / 60', 1, ' hrs')} AS hours_display,
          greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({oracle.pct('part', 'whole')}) * 3 - 50)) AS clamped FROM sums""",
    "option_outcomes": oracle.sql(
        f"""SELECT option_id, CASE WHEN lower(trim(approval_status)) IN {oracle.words(oracle.WON_STATES)}
               OR status IN {oracle.words(oracle.WON_STATES)} THEN 'won'
             WHEN lower(trim(approval_status)) IN {oracle.words(oracle.LOST_STATES)}
               OR status IN {oracle.words(oracle.LOST_STATES)} THEN 'lost' ELSE 'pending' END AS outcome,
             CASE WHEN approval_status IS NOT NULL THEN lower(trim(approval_status))
               WHEN status <> '' THEN status ELSE 'unknown' END AS bucket FROM estimate_options"""
    ),
    "best_outcome": oracle.sql(
        """SELECT estimate_id, CASE weight WHEN 3 THEN 'won' WHEN 2 THEN 'lost' ELSE 'pending' END AS outcome
           FROM outcome_of"""
    ),
    "time_displays": f"""SELECT o_orderkey, {oracle.display(_TS)} AS central,
          CASE WHEN {_TS} IS NULL THEN '' ELSE {oracle.display_zone(_TS)} END AS central_with_zone,
          strftime({_TS}, '%Y-%m') AS month, strftime({_TS}, '%Y-%m-%d') AS day,
          strftime(timezone('UTC', timezone('America/Chicago', date_trunc('year', {oracle.central(_TS)}))),
            '%Y-%m-%d %H:%M') AS year_start FROM orders""",
    "time_parsing": f"""SELECT event_id, strftime(CASE event_id % 7 WHEN 0 THEN date_trunc('day', ts)
          WHEN 1 THEN {_SECOND} WHEN 2 THEN {_SECOND}
          WHEN 3 THEN {_SECOND} + INTERVAL 6 HOUR + INTERVAL 250 MILLISECOND
          WHEN 4 THEN {_SECOND} END, '%Y-%m-%d %H:%M:%S.%g') AS parsed FROM events""",
    "names": f"""SELECT c_custkey::VARCHAR AS customer_id,
          trim(coalesce(trim({_FIRST}), 'Unknown') || ' ' || coalesce(trim({_LAST}), '')) AS customer_name,
          coalesce(nullif(trim(coalesce(trim({_FIRST}), '') || ' ' || coalesce(trim({_LAST}), '')), ''), 'Unknown')
            AS employee_name,
          coalesce(nullif(trim({_LAST}), ''), 'Technician') AS role, c_custkey % 5 = 0 AS raw_id FROM customer""",
    "share_rounding": f"""SELECT l_returnflag, l_linestatus, n, share FROM ({oracle.shares(
        '''SELECT l_returnflag, l_linestatus, count(*) AS n,
             count(*) / sum(count(*)) OVER () * 100.0::DOUBLE AS raw FROM lineitem GROUP BY ALL''',
        'n', 'l_returnflag, l_linestatus')})""",
    "table_audit": oracle.sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, "
            + ("0 AS row_count" if name == "pricebook_services" else f"count(*) AS row_count FROM {name}")
            for name in COUNTED
        )
    ),
    "latest_n": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100",
    "newest_jobs": oracle.sql(
        """SELECT job_id, work_status, strftime(completed_at, '%Y-%m-%d') AS completed FROM jobs
           ORDER BY completed_at DESC NULLS LAST, job_id LIMIT 10"""
    ),
    "semi_join_ytd": oracle.sql(
        f"""SELECT option_id, estimate_id, total_amount FROM estimate_options WHERE estimate_id IN
            (SELECT estimate_id FROM estimates WHERE created_at >= {oracle.YEAR_START})"""
    ),
    "employee_dim_fallback": oracle.sql(
        """SELECT DISTINCT p.employee_id, trim(first_name) || ' ' || trim(last_name) AS employee_name, role
           FROM job_employees j JOIN people p ON j.employee_id = p.employee_id"""
    ),
    "appointment_counts": oracle.sql("SELECT job_id, n AS counted FROM visit_counts"),
    "incremental_window": oracle.sql(
        """SELECT job_id, work_status, strftime(updated_at, '%Y-%m-%d') AS updated FROM jobs
           WHERE updated_at >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 60 DAY"""
    ),
    "details_wanted": oracle.sql(
        """SELECT job_id FROM jobs WHERE work_status = 'complete rated'
             AND updated_at >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 45 DAY"""
    ),
}

_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NS": "timestamp_ntz"}
_KIND_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_PRESENT = {"orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate", "lineitem": "l_orderkey l_linenumber l_quantity", "events": "event_id ts value props", "documents": "doc_id text lang"}
SQL["table_presence"] = f"SELECT table_name, present, column_name, {_KIND_SQL} AS type, filled FROM (" + " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, true AS present, '{c}' AS column_name, typeof(any_value({c})) AS t, count({c}) AS filled FROM {t}" for t, columns in _PRESENT.items() for c in columns.split()]
    + ["SELECT 'documents', true, 'author', NULL, NULL", "SELECT 'calls', false, 'call_id', NULL, NULL"]
) + ")"
