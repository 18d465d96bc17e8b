"""Declared schema of every stored table, and conforming frames to it.

Stored tables are typed: timestamps instead of ISO text, and money as whole cents
in bigint columns. Parquet has no keys, so the key of a table is kept up by
``operators.upsert``; the KPI code relies on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructType, TimestampType

from wrenchlight.functions.numbers import to_cents
from wrenchlight.functions.times import parse_time

# Column that stored tables have besides the declared ones: when and where a record arrived, as text that sorts by it.
ARRIVED = "_arrived"


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    keys: tuple[str, ...]
    # Key columns in which NULL is a value of its own, the same as ''.
    nullable_keys: tuple[str, ...] = ()
    # Column that tells which of two rows with one key is newer.
    version: str | None = None
    # Columns that name the parent record, for child tables.
    parent: tuple[str, ...] = ()
    # Date by which stored tables are laid out, so that a filter on it skips files and row groups.
    laid_out_by: str | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def stored_schema(self) -> StructType:
        return self.schema.add(ARRIVED, "string")

    @property
    def newest(self) -> tuple[str, ...]:
        """What tells which of two rows with one key is newer, most important first."""
        return (self.version, ARRIVED) if self.version else (ARRIVED,)

    @property
    def full_key(self) -> tuple[str, ...]:
        return self.keys + self.nullable_keys


_SPECS = (
    TableSpec(
        "jobs",
        """job_id string, invoice_number string, description string, customer_id string,
        work_status string, total_amount bigint, outstanding_balance bigint, subtotal bigint,
        tags string, created_at timestamp, updated_at timestamp, completed_at timestamp,
        scheduled_start timestamp, scheduled_end timestamp, num_appointments int,
        company_id string, company_name string""",
        keys=("job_id",),
        version="updated_at",
        laid_out_by="completed_at",
    ),
    TableSpec(
        "job_employees",
        """job_id string, employee_id string, first_name string, last_name string, email string,
        mobile_number string, color_hex string, avatar_url string, role string""",
        keys=("job_id", "employee_id"),
        parent=("job_id",),
    ),
    TableSpec(
        "customers",
        """customer_id string, first_name string, last_name string, email string,
        mobile_number string, company string, created_at timestamp, updated_at timestamp""",
        keys=("customer_id",),
        version="updated_at",
    ),
    TableSpec(
        "invoices",
        """invoice_id string, job_id string, invoice_number string, status string, amount bigint,
        subtotal bigint, due_amount bigint, due_at timestamp, paid_at timestamp, sent_at timestamp,
        service_date timestamp, invoice_date timestamp, display_due_concept string,
        due_concept string""",
        keys=("invoice_id",),
        laid_out_by="invoice_date",
    ),
    TableSpec(
        "employees",
        """employee_id string, first_name string, last_name string, email string,
        mobile_number string, role string, avatar_url string, color_hex string,
        company_id string, company_name string""",
        keys=("employee_id",),
    ),
    TableSpec(
        "job_appointments",
        """job_id string, appointment_id string, start_time timestamp, end_time timestamp,
        anytime boolean, arrival_window_minutes int, dispatched_employee_id string,
        duration_minutes double""",
        keys=("job_id", "appointment_id"),
        nullable_keys=("dispatched_employee_id",),
        parent=("job_id",),
        laid_out_by="start_time",
    ),
    TableSpec(
        "invoice_items",
        """invoice_id string, job_id string, item_id string, name string, type string,
        qty_in_hundredths int, unit_cost bigint, unit_price bigint, amount bigint,
        description string""",
        keys=("invoice_id",),
        nullable_keys=("item_id",),
        parent=("invoice_id",),
    ),
    TableSpec(
        "estimates",
        """estimate_id string, estimate_number string, work_status string, lead_source string,
        customer_id string, scheduled_start timestamp, scheduled_end timestamp,
        created_at timestamp, updated_at timestamp, company_id string, company_name string""",
        keys=("estimate_id",),
        version="updated_at",
        laid_out_by="created_at",
    ),
    TableSpec(
        "estimate_options",
        """option_id string, estimate_id string, name string, option_number string,
        total_amount bigint, status string, approval_status string, created_at timestamp,
        updated_at timestamp""",
        keys=("option_id",),
        version="updated_at",
        parent=("estimate_id",),
    ),
    TableSpec(
        "estimate_employees",
        "estimate_id string, employee_id string, first_name string, last_name string",
        keys=("estimate_id", "employee_id"),
        parent=("estimate_id",),
    ),
    TableSpec(
        "pricebook_services",
        """service_uuid string, name string, task_number string, description string, price double,
        cost double, duration int, managed_by string, flat_rate_enabled boolean, taxable boolean,
        unit_of_measure string, category_name string, industry_name string, updated_at timestamp""",
        keys=("service_uuid",),
        version="updated_at",
    ),
    TableSpec(
        "pricebook_materials",
        """material_uuid string, name string, part_number string, unit_of_measure string,
        cost double, price double, taxable boolean, material_category_name string""",
        keys=("material_uuid",),
    ),
    # Key/value facts about loads, one row per load and key; the latest row of a key counts.
    TableSpec(
        "load_log",
        "key string, value string, recorded_at timestamp",
        keys=("key", "recorded_at"),
        version="recorded_at",
    ),
)

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}


def _convert(current: DataType, wanted: DataType, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(wanted, TimestampType) and isinstance(current, StringType):
        return parse_time(column)
    if isinstance(wanted, LongType):
        return to_cents(column)
    return column.try_cast(wanted)


def conform(df: DataFrame, table: str | TableSpec) -> DataFrame:
    """Exactly the declared columns: absent ones as typed NULLs, others converted, extras dropped.

    A column that already has its type passes through unchanged, which keeps
    filters and column pruning pushed down to the scan. The time of arrival stays
    where there is one.
    """
    spec = TABLES[table] if isinstance(table, str) else table
    schema = spec.schema
    present = {f.name.lower(): f for f in df.schema.fields}
    if ARRIVED in present:
        schema = spec.stored_schema
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]:
        return df
    columns: list[Column | str] = []
    for wanted in schema.fields:
        have = present.get(wanted.name)
        if have is None:
            columns.append(F.expr(f"CAST(NULL AS {wanted.dataType.simpleString()}) AS {wanted.name}"))
        elif have.dataType == wanted.dataType:
            columns.append(wanted.name)
        else:
            columns.append(_convert(have.dataType, wanted.dataType, have.name).alias(wanted.name))
    return df.select(*columns)


def with_arrival(df: DataFrame) -> DataFrame:
    """``df`` with the column for the time of arrival, NULL where it had none."""
    return df if ARRIVED in df.columns else df.withColumn(ARRIVED, F.lit(None).cast("string"))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table].schema)


def schema_listing(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type): what DESCRIBE shows, for any set of tables, without the time of arrival."""
    rows = [
        (name, position, f.name, f.dataType.simpleString())
        for name, frame in frames.items()
        for position, f in enumerate(f for f in frame.schema.fields if f.name != ARRIVED)
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
