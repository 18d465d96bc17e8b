"""The given tables seen as field-service tables (rules in FIXTURES.md §3).

Everything is row by row, plus the joins of orders with customers and of lines
with parts; no rows are left out but where a rule says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlight.plans.context import Context
from wrenchlight.session import prepare
from wrenchlight.sources.tables import Tables

AS_OF = "2001-08-02T00:00:00+00:00"

# Columns read from each given table; declaring them saves reading footers up front.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _cents(price: str) -> str:
    return f"cast(floor({price} / 5) AS bigint)"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than that, as one small file has.

    For rows that are costly to work on. A table of many files passes as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Line number, part, supplier, day and price name a line.
_LINE = """l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyy-MM-dd'),
    cast(round(l_extendedprice * 100) AS bigint)"""

_TAGS = """CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN concat(
    CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Residential' ELSE 'Commercial' END, ', ',
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Demand Service, DFO'
         WHEN o_orderpriority = '2-HIGH' THEN 'Install'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Maintenance'
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0 THEN 'Service, Call Back'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Service'
         ELSE 'New Construction' END) END"""

# The option states that occur.
_WON = """array('approved', 'pro approved', 'accepted', 'won', 'sold', 'selected', 'created job from estimate',
    'complete rated', 'complete unrated', 'scheduled', 'in progress')"""
_LOST = "array('declined', 'pro declined', 'rejected', 'lost', 'expired', 'canceled', 'cancelled', 'deleted', 'void')"

_PERSON = (
    "cast(s_suppkey AS string) AS employee_id",
    "split(s_name, '#')[0] AS first_name",
    "split(s_name, '#')[1] AS last_name",
    "CASE WHEN s_suppkey % 10 <> 0 THEN 'Senior Tech' END AS role",
)


class Bridge:
    """Loader of the field-service tables that the given ones stand for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame | None:
        build = getattr(self, name, None)
        return build() if build else None

    def _given(self, name: str) -> DataFrame:
        return given(self.spark, self.folder, name)

    def _orders(self) -> DataFrame:
        return self._given("orders")

    def _orders_with_customer(self) -> DataFrame:
        return self._orders().join(self._given("customer"), F.expr("o_custkey = c_custkey"))

    def _assignments(self) -> DataFrame:
        return self._given("lineitem").select("l_orderkey", "l_suppkey").distinct()

    def customers(self) -> DataFrame:
        return self._given("customer").selectExpr(
            "cast(c_custkey AS string) AS customer_id",
            "split(c_name, '#')[0] AS first_name",
            "split(c_name, '#')[1] AS last_name",
        )

    def employees(self) -> DataFrame:
        return self._given("supplier").selectExpr(*_PERSON)

    def jobs(self) -> DataFrame:
        return self._orders_with_customer().selectExpr(
            "concat('job_', o_orderkey) AS job_id",
            "cast(o_custkey AS string) AS customer_id",
            """CASE o_orderstatus WHEN 'F' THEN 'complete rated' WHEN 'P' THEN 'Complete Unrated'
                ELSE 'in progress' END AS work_status""",
            "CASE WHEN o_orderstatus <> 'O' THEN cast(o_orderdate AS timestamp) END AS completed_at",
            "cast(o_orderdate AS timestamp) AS updated_at",
            f"{_cents('o_totalprice')} AS total_amount",
            "CASE WHEN o_orderkey % 7 = 0 THEN 'Wizard Club visit' ELSE 'Repair call' END AS description",
            f"{_TAGS} AS tags",
        )

    def job_employees(self) -> DataFrame:
        pairs = self._assignments().join(self._given("supplier"), F.expr("l_suppkey = s_suppkey"))
        return pairs.selectExpr("concat('job_', l_orderkey) AS job_id", *_PERSON)

    def job_appointments(self) -> DataFrame:
        return self._given("lineitem").selectExpr(
            "concat('job_', l_orderkey) AS job_id",
            "cast(l_linenumber AS string) AS appointment_id",
            "cast(l_suppkey AS string) AS dispatched_employee_id",
            "cast(l_shipdate AS timestamp) AS start_time",
            "cast(l_shipdate AS timestamp) + make_dt_interval(0, 0, cast(l_quantity * 6 AS int)) AS end_time",
        )

    def invoices(self) -> DataFrame:
        return self._orders().selectExpr(
            "concat('inv_', o_orderkey) AS invoice_id",
            "concat('job_', o_orderkey) AS job_id",
            """CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'pending_payment' WHEN 2 THEN 'paid'
                ELSE 'voided' END AS status""",
            f"{_cents('o_totalprice')} AS amount",
            "cast(o_orderdate AS timestamp) AS invoice_date",
        )

    def invoice_items(self) -> DataFrame:
        lines = self._given("lineitem").join(self._given("part"), F.expr("l_partkey = p_partkey"))
        return lines.selectExpr(
            "concat('inv_', l_orderkey) AS invoice_id",
            "concat('job_', l_orderkey) AS job_id",
            f"concat_ws('-', {_LINE}) AS item_id",
            """CASE WHEN p_type = 'PROMO' AND p_size < 5 THEN 'Wizard Club Membership'
                ELSE p_name END AS name""",
            "cast(l_quantity * 100 AS int) AS qty_in_hundredths",
            f"{_cents('l_extendedprice')} AS amount",
        )

    def estimates(self) -> DataFrame:
        return self._orders_with_customer().selectExpr(
            "concat('est_', o_orderkey) AS estimate_id",
            "cast(o_custkey AS string) AS customer_id",
            "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE concat(c_mktsegment, ' ') END AS lead_source",
            "cast(o_orderdate AS timestamp) AS created_at",
        )

    def estimate_options(self) -> DataFrame:
        return self._given("lineitem").selectExpr(
            f"concat_ws('-', {_LINE}, l_orderkey) AS option_id",
            "concat('est_', l_orderkey) AS estimate_id",
            f"""CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 2 = 0
                THEN upper(element_at({_WON}, cast(l_partkey % 11 + 1 AS int)))
                WHEN l_returnflag = 'R' AND l_partkey % 2 = 0
                THEN concat(element_at({_LOST}, cast(l_partkey % 9 + 1 AS int)), ' ') END AS approval_status""",
            f"""CASE WHEN l_linestatus = 'O' THEN 'submitted' WHEN l_returnflag = 'A' AND l_partkey % 2 = 1
                THEN element_at({_WON}, cast(l_partkey % 11 + 1 AS int))
                WHEN l_returnflag = 'R' AND l_partkey % 2 = 1
                THEN element_at({_LOST}, cast(l_partkey % 9 + 1 AS int)) ELSE '' END AS status""",
            f"{_cents('l_extendedprice')} AS total_amount",
        )

    def estimate_employees(self) -> DataFrame:
        return self._assignments().selectExpr(
            "concat('est_', l_orderkey) AS estimate_id", "cast(l_suppkey AS string) AS employee_id"
        )

    def load_log(self) -> DataFrame:
        """Every event notes one fact about a load, at its time in whole seconds."""
        return self._given("events").selectExpr(
            """CASE event_id % 3 WHEN 0 THEN 'last_refresh' WHEN 1 THEN 'last_window_start'
                ELSE 'last_window_end' END AS key""",
            "date_format(date_trunc('second', ts), \"yyyy-MM-dd'T'HH:mm:ssXXX\") AS value",
            "cast(ts AS timestamp) AS recorded_at",
        )


def tables(spark: SparkSession, folder: str) -> Tables:
    prepare(spark)
    return Tables(spark, Bridge(spark, folder))


def context(spark: SparkSession, folder: str, as_of: str = AS_OF) -> Context:
    return Context(tables(spark, folder), as_of)
