"""The populations every KPI starts from."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.functions import labels, text, times
from wrenchlight.functions.labels import BILLED_STATES, COMPLETED_STATES
from wrenchlight.operators.filters import FILTER_FROM_BYTES, near
from wrenchlight.sources.tables import Tables


class Context:
    """Tables plus the moment the KPIs are computed for.

    The year starts in the business zone, months and days are cut in UTC, and
    dates after ``as_of`` count. Populations are lazy and hold only the columns
    the KPIs use; filters sit directly on the stored columns, so they reach the
    Parquet scan. Tables without a date of their own, whose scan reads ``filter_from`` bytes
    or more, are cut by a Bloom filter of the year's keys before they are shuffled.
    """

    def __init__(
        self,
        tables: Tables,
        as_of: datetime | str | Column | None = None,
        zone: str = times.BUSINESS_ZONE,
        filter_from: int = FILTER_FROM_BYTES,
    ):
        self.filter_from = filter_from
        self.tables = tables
        self.zone = zone
        self.as_of: Column = times.instant(datetime.now(timezone.utc) if as_of is None else as_of)
        self.year_start: Column = times.year_start(self.as_of, zone)
        self.utc_year_start: Column = times.utc_year_start(self.as_of)

    # ---- jobs --------------------------------------------------------------

    @cached_property
    def completed(self) -> DataFrame:
        """Jobs completed since the start of the year, one row per job."""
        jobs = self.tables["jobs"]
        done = F.lower("work_status").isin(*COMPLETED_STATES)
        return jobs.filter(done & (F.col("completed_at") >= self.year_start)).select(
            "job_id",
            "customer_id",
            "work_status",
            "description",
            "completed_at",
            "num_appointments",
            text.normalize_tags("tags").alias("tags_norm"),
        )

    @cached_property
    def appointment_counts(self) -> DataFrame:
        """Distinct appointments of every job that has any."""
        return _counted_visits(self.tables["job_appointments"].filter(F.col("job_id").isNotNull()))

    @cached_property
    def completed_visits(self) -> DataFrame:
        """``completed`` with the counted appointments, else the stored number, else 0."""
        jobs = self.completed.select("job_id")
        visits = self._near(self.tables["job_appointments"], jobs, "job_id").join(jobs, "job_id", "left_semi")
        joined = self.completed.join(_counted_visits(visits), "job_id", "left")
        number = F.coalesce("counted", "num_appointments", F.lit(0)).cast("bigint")
        return joined.withColumn("num_appointments", number).drop("counted")

    def _near(self, rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """``rows`` cut to roughly the ``keys``, where that pays; an exact join follows."""
        return near(rows, keys, key, self.filter_from)

    @cached_property
    def job_categories(self) -> DataFrame:
        """(job_id, category) of the billed jobs that may have one, and maybe of others; any other job is unclassified.

        The label is taken from the tags below the shuffle, which then carries
        short labels of some jobs instead of the tags of all.
        """
        jobs = self._near(self.tables["jobs"].filter(labels.may_have_category("tags")), self.billed, "job_id")
        return jobs.select("job_id", labels.job_category("tags").alias("category"))

    @cached_property
    def install_jobs(self) -> DataFrame:
        """(job_id) of the billed jobs in an install category, and maybe of others."""
        jobs = self._near(self.tables["jobs"].filter(labels.may_be_install("tags")), self.billed, "job_id")
        return jobs.filter(labels.is_install_category(labels.job_category("tags"))).select("job_id")

    # ---- invoices ----------------------------------------------------------

    @cached_property
    def billed(self) -> DataFrame:
        """Invoices billed since the start of the year, paid or not."""
        invoices = self.tables["invoices"]
        open_now = F.lower("status").isin(*BILLED_STATES)
        return invoices.filter(open_now & (F.col("invoice_date") >= self.year_start)).select(
            "invoice_id", "job_id", "invoice_date", F.coalesce("amount", F.lit(0)).alias("cents")
        )

    @cached_property
    def billed_by_category(self) -> DataFrame:
        """(category, cents, invoice_count). Summed per job before the join, so it has no hot key."""
        per_job = self.billed.groupBy("job_id").agg(
            F.sum("cents").alias("cents"), F.count("invoice_id").alias("invoice_count")
        )
        labelled = per_job.join(self.job_categories, "job_id", "left")
        category = F.coalesce("category", F.lit(labels.UNCLASSIFIED)).alias("category")
        return labelled.groupBy(category).agg(
            F.sum("cents").alias("cents"), F.sum("invoice_count").alias("invoice_count")
        )

    # ---- estimates ---------------------------------------------------------

    @cached_property
    def estimates_this_year(self) -> DataFrame:
        return self.tables["estimates"].filter(F.col("created_at") >= self.year_start)

    @cached_property
    def outcomes(self) -> DataFrame:
        """(estimate_id, created_at, lead_source, outcome) of the year, one row per estimate.

        The best option decides: won over lost over pending; pending without options.
        Options are cut to the year's estimates, then reduced to one weight per estimate, then joined.
        """
        weight = labels.outcome_weight("approval_status", "status")
        estimates = self.estimates_this_year.select("estimate_id", "created_at", "lead_source")
        keys = estimates.select("estimate_id")
        options = self._near(self.tables["estimate_options"], keys, "estimate_id").join(keys, "estimate_id", "left_semi")
        best = options.groupBy("estimate_id").agg(F.max(weight).alias("weight"))
        joined = estimates.join(best, "estimate_id", "left")
        return joined.withColumn("outcome", labels.outcome_name("weight")).drop("weight")

    # ---- people ------------------------------------------------------------

    @cached_property
    def year_jobs(self) -> DataFrame:
        """(job_id) of the jobs completed or billed this year; a job may occur several times."""
        return self.completed.select("job_id").unionByName(self.billed.select("job_id"))

    @cached_property
    def crew(self) -> DataFrame:
        """(job_id, employee_id) as stored, of the year's jobs and maybe of others; a pair may occur several times."""
        pairs = self.tables["job_employees"].select("job_id", "employee_id")
        return self._near(pairs.dropna(), self.year_jobs, "job_id")

    @cached_property
    def year_crew(self) -> DataFrame:
        """(job_id, employee_id) of the year's jobs, each pair once."""
        return self.crew.join(self.year_jobs, "job_id", "left_semi").distinct()

    @cached_property
    def employees(self) -> DataFrame:
        """One row per employee, from the employees table, or from the job crews if that is empty.

        Whether it is empty is asked while the plan is built, by a job that reads one row.
        """
        master = self.tables["employees"]
        listed = master.isEmpty()
        return crew_as_employees(self.tables) if listed else employee_dimension(master)

    # ---- reuse -------------------------------------------------------------

    def materialized(self, folder: str) -> Context:
        """A context whose populations are read back from Parquet written to ``folder``.

        For computing many KPIs in one go: the large tables are scanned once, and
        later queries do not depend on the executors that did it.
        """
        copy = Context(self.tables, self.as_of, self.zone, self.filter_from)
        for name in MATERIALIZED:
            copy.keep(name, getattr(self, name), folder)
        # The same jobs; nothing but the visits looks at the number of appointments.
        copy.__dict__["completed"] = copy.completed_visits
        copy.__dict__["crew"] = copy.year_crew
        return copy

    def keep(self, name: str, frame: DataFrame, folder: str) -> None:
        """Write a frame below ``folder`` and use what is read back under this name from now on."""
        frame.write.parquet(f"{folder}/{name}")
        self.__dict__[name] = self.tables.spark.read.schema(frame.schema).parquet(f"{folder}/{name}")


def _counted_visits(visits: DataFrame) -> DataFrame:
    """(job_id, counted). Spark counts distinct appointments in two steps, so no job is too large."""
    return visits.groupBy("job_id").agg(F.count_distinct("appointment_id").alias("counted"))


# Populations that several KPIs read.
MATERIALIZED = ("completed_visits", "billed", "billed_by_category", "outcomes", "year_crew", "employees")

EMPLOYEE_COLUMNS = ("employee_id", "first_name", "last_name", "role", "avatar_url", "color_hex")


def employee_dimension(employees: DataFrame) -> DataFrame:
    named = text.employee_name("first_name", "last_name").alias("employee_name")
    return employees.filter(F.col("employee_id").isNotNull()).select(*EMPLOYEE_COLUMNS, named)


def crew_as_employees(tables: Tables) -> DataFrame:
    """Employees as they appear in job crews, the fullest entry of each.

    Entries are compared as structs (filled columns first, then their values), so
    each task keeps one entry per employee before anything is sent.
    """
    details = [c for c in EMPLOYEE_COLUMNS if c != "employee_id"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in details), F.lit(0))
    entry = F.struct(filled.alias("filled"), *details)
    crews = tables["job_employees"].filter(F.col("employee_id").isNotNull())
    best = crews.groupBy("employee_id").agg(F.max(entry).alias("best"))
    return employee_dimension(best.select("employee_id", *[F.col(f"best.{c}") for c in details]))
