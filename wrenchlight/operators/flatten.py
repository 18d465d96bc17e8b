"""Nested items -> flat tables.

Every function takes the items of one entity (see ``sources.landing``) and
returns a frame that conforms to the declared schema of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions.labels import COMPLETED_STATES
from wrenchlight.schemas import ARRIVED, conform


def _same(*names: str) -> list[Column]:
    return [F.col(name) for name in names]


def _arrival(items: DataFrame) -> list[Column]:
    """The time of arrival, where items have one."""
    return [F.col(ARRIVED)] if ARRIVED in items.columns else []


def _each(items: DataFrame, array: str, *parent: Column) -> DataFrame:
    """One row per array element; parents without elements give no rows."""
    parent = (*parent, *_arrival(items))
    return items.select(*parent, F.explode(array).alias("element")).select(
        *[F.col(f"`{name}`") for name in items.select(*parent).columns], "element.*"
    )


def jobs(items: DataFrame) -> DataFrame:
    """Job headers. The appointment count is not in the items, see ``with_appointment_counts``.

    Stored jobs leave it NULL: the KPIs count ``job_appointments``, so it cannot differ from them.
    """
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ","))
    flat = items.select(
        F.col("id").alias("job_id"),
        *_same("invoice_number", "description", "work_status"),
        *_same("total_amount", "outstanding_balance", "subtotal", "created_at", "updated_at"),
        F.col("customer.id").alias("customer_id"),
        tags.alias("tags"),
        F.col("work_timestamps.completed_at").alias("completed_at"),
        F.col("schedule.scheduled_start").alias("scheduled_start"),
        F.col("schedule.scheduled_end").alias("scheduled_end"),
        *_arrival(items),
    )
    return conform(flat, "jobs")


def job_employees(items: DataFrame) -> DataFrame:
    crew = _each(items, "assigned_employees", F.col("id").alias("job_id"))
    return conform(crew.withColumnRenamed("id", "employee_id"), "job_employees")


def job_appointments(details: DataFrame) -> DataFrame:
    """Appointment x dispatched employee; an appointment without one keeps a row with NULL."""
    visits = details.select(
        F.col("id").alias("job_id"), F.explode("schedule.appointments").alias("visit"), *_arrival(details)
    )
    sent = F.col("visit.dispatched_employees_ids")
    flat = visits.select(
        "job_id",
        "visit.start_time",
        "visit.end_time",
        "visit.anytime",
        "visit.arrival_window_minutes",
        "visit.duration_minutes",
        F.col("visit.id").alias("appointment_id"),
        F.explode_outer(F.when(F.size(sent) > 0, sent)).alias("dispatched_employee_id"),
        *_arrival(details),
    )
    return conform(flat, "job_appointments")


def appointment_counts(details: DataFrame) -> DataFrame:
    """(job_id, num_appointments), 0 where a job has none; of re-sent details the one that arrived last counts.

    Where the details have no time of arrival, the largest count does.
    """
    found = F.greatest(F.coalesce(F.size("schedule.appointments"), F.lit(0)), F.lit(0)).alias("n")
    sizes = details.select(F.col("id").alias("job_id"), F.struct(*_arrival(details), found).alias("newest"))
    return sizes.groupBy("job_id").agg(F.max("newest").alias("newest")).select("job_id", F.col("newest.n").alias("num_appointments"))


def with_appointment_counts(jobs_table: DataFrame, counts: DataFrame) -> DataFrame:
    """Jobs with their count from the details, 0 for jobs without details."""
    joined = jobs_table.drop("num_appointments").join(counts, "job_id", "left")
    filled = joined.withColumn("num_appointments", F.coalesce("num_appointments", F.lit(0)))
    return conform(filled, "jobs")


def jobs_wanting_details(jobs_table: DataFrame, since: Column | None = None) -> DataFrame:
    """(job_id) of completed jobs, whose details are worth fetching.

    The state is compared as it is written. With ``since``, only jobs completed or
    changed from then on; without, all of them.
    """
    wanted = F.col("work_status").isin(*COMPLETED_STATES) & F.col("job_id").isNotNull()
    if since is not None:
        late = [F.coalesce(F.col(c) >= since, F.lit(False)) for c in ("completed_at", "updated_at")]
        wanted = wanted & (late[0] | late[1])
    return jobs_table.filter(wanted).select("job_id")


def customers(items: DataFrame) -> DataFrame:
    return conform(items.withColumnRenamed("id", "customer_id"), "customers")


def invoices(items: DataFrame) -> DataFrame:
    return conform(items.withColumnRenamed("id", "invoice_id"), "invoices")


def invoice_items(items: DataFrame) -> DataFrame:
    lines = _each(items, "items", F.col("id").alias("invoice_id"), F.col("job_id"))
    return conform(lines.withColumnRenamed("id", "item_id"), "invoice_items")


def employees(items: DataFrame) -> DataFrame:
    return conform(items.withColumnRenamed("id", "employee_id"), "employees")


def estimates(items: DataFrame) -> DataFrame:
    flat = items.select(
        F.col("id").alias("estimate_id"),
        *_same("estimate_number", "work_status", "lead_source", "created_at", "updated_at"),
        *_same("company_id", "company_name"),
        F.col("customer.id").alias("customer_id"),
        F.col("schedule.scheduled_start").alias("scheduled_start"),
        F.col("schedule.scheduled_end").alias("scheduled_end"),
        *_arrival(items),
    )
    return conform(flat, "estimates")


def estimate_options(items: DataFrame) -> DataFrame:
    options = _each(items, "options", F.col("id").alias("estimate_id"))
    return conform(options.withColumnRenamed("id", "option_id"), "estimate_options")


def estimate_employees(items: DataFrame) -> DataFrame:
    crew = _each(items, "assigned_employees", F.col("id").alias("estimate_id"))
    return conform(crew.withColumnRenamed("id", "employee_id"), "estimate_employees")


def pricebook_services(items: DataFrame) -> DataFrame:
    """The uuid, else the id, is the key; services with neither are left out."""
    key = F.coalesce(F.nullif("uuid", F.lit("")), F.nullif("id", F.lit("")))
    flat = items.select(
        key.alias("service_uuid"),
        *_same("name", "task_number", "description", "price", "cost", "duration", "managed_by"),
        *_same("flat_rate_enabled", "taxable", "unit_of_measure", "updated_at"),
        F.coalesce("category_name", "category.name").alias("category_name"),
        F.coalesce("industry_name", "industry.name").alias("industry_name"),
        *_arrival(items),
    )
    return conform(flat.filter(F.col("service_uuid").isNotNull()), "pricebook_services")


def pricebook_materials(items: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif("uuid", F.lit("")), F.nullif("id", F.lit("")))
    flat = items.withColumn("material_uuid", key).filter(F.col("material_uuid").isNotNull())
    return conform(flat, "pricebook_materials")


# Which tables come out of which entity.
FLATTENERS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "employees": {"employees": employees},
    "estimates": {
        "estimates": estimates,
        "estimate_options": estimate_options,
        "estimate_employees": estimate_employees,
    },
    "jobs": {"jobs": jobs, "job_employees": job_employees},
    "job_details": {"job_appointments": job_appointments},
    "customers": {"customers": customers},
    "invoices": {"invoices": invoices, "invoice_items": invoice_items},
    "pricebook_services": {"pricebook_services": pricebook_services},
    "pricebook_materials": {"pricebook_materials": pricebook_materials},
}
