"""Landing, flattening, upserts and the file stream, over pages made from the given tables.

Pages are JSON texts built row by row, so no group of rows is ever gathered:
a row's own key decides how many nested elements its items have (0 to 3).
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlight.operators import flatten
from wrenchlight.operators.upsert import latest_per_key, upsert
from wrenchlight.plans.audit import table_counts
from wrenchlight.schemas import ARRIVED
from wrenchlight.session import prepare, shared_folder
from wrenchlight.sources.landing import missing_pages, page_envelope, page_items, page_schema, parse_pages, with_file_arrival
from wrenchlight.sources.load import load_all
from wrenchlight.sources.tables import Tables
from wrenchlight.sources.warehouse import Warehouse
from wrenchlight.streaming.changes import as_items, as_records, changes
from wrenchlight.streaming.feed import start_feed
from workload.bridge import AS_OF, given, spread


def _times(n: Column, element) -> Column:
    """An array of n elements, element(1) to element(n); NULL for none."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), element))


def _page(rows: DataFrame, entity: str, item: Column, own_key: Column) -> DataFrame:
    """One page text per row, its item under the entity's name or under ``data``."""
    items = F.array(item)
    page = F.struct(
        F.when(own_key, items).alias(entity),
        F.when(~own_key, items).alias("data"),
        F.lit(1).alias("page"),
        F.when(own_key, 1).alias("total_pages"),
        F.when(~own_key, 1).alias("total_pages_count"),
    )
    return spread(rows).select(F.to_json(page).alias("page"))


def _number(column: str, modulo: int) -> Column:
    return (F.col(column) % modulo).cast("int")


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return given(spark, folder, "orders")


def job_pages(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tags = F.when(key % 5 == 1, F.array().cast("array<string>")).when(
        key % 5 > 1, F.array(F.col("o_orderpriority"), F.lit("Residential"))
    )
    crew = _times(
        _number("o_orderkey", 4),
        lambda i: F.struct(
            F.concat(F.lit("pro_"), ((key + i) % 50).cast("string")).alias("id"),
            F.concat(F.lit("Tech "), i.cast("string")).alias("first_name"),
            F.when(i > 1, "field tech").alias("role"),
        ),
    )
    item = F.struct(
        F.concat(F.lit("job_"), key.cast("string")).alias("id"),
        F.when(status == "F", "complete rated").otherwise("in progress").alias("work_status"),
        F.floor(F.col("o_totalprice") / 5).cast("bigint").alias("total_amount"),
        tags.alias("tags"),
        _day("o_orderdate").alias("updated_at"),
        F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        F.when(status == "F", F.struct(_day("o_orderdate").alias("completed_at"))).alias("work_timestamps"),
        F.struct(_day("o_orderdate").alias("scheduled_start")).alias("schedule"),
        crew.alias("assigned_employees"),
    )
    return _page(_orders(spark, folder), "jobs", item, key % 2 == 0)


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Job details come without an envelope."""
    key = F.col("o_orderkey")

    def visit(i: Column) -> Column:
        sent = _times(
            ((key + i) % 3).cast("int"), lambda j: F.concat(F.lit("pro_"), (j * 10 + i).cast("string"))
        )
        return F.struct(
            F.concat_ws("-", key, i).alias("id"),
            _day("o_orderdate").alias("start_time"),
            (i == 1).alias("anytime"),
            (i * 30).alias("arrival_window_minutes"),
            F.coalesce(sent, F.array().cast("array<string>")).alias("dispatched_employees_ids"),
        )

    schedule = F.struct(_times(_number("o_orderkey", 4), visit).alias("appointments"))
    item = F.struct(
        F.concat(F.lit("job_"), key.cast("string")).alias("id"),
        F.when(key % 8 != 0, schedule).alias("schedule"),
    )
    return spread(_orders(spark, folder)).select(F.to_json(item).alias("page"))


def invoice_pages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    lines = _times(
        _number("o_orderkey", 3),
        lambda i: F.struct(
            F.when(i == 1, F.concat(F.lit("line_"), key.cast("string"))).alias("id"),
            F.concat(F.lit("Part "), i.cast("string")).alias("name"),
            (i * 100).alias("qty_in_hundredths"),
            (F.floor("o_totalprice") * i).alias("amount"),
        ),
    )
    item = F.struct(
        key.alias("id"),
        F.when(key % 6 != 0, key + 1).alias("job_id"),
        F.lit("open").alias("status"),
        F.floor("o_totalprice").alias("amount"),
        _day("o_orderdate").alias("invoice_date"),
        lines.alias("items"),
    )
    return _page(_orders(spark, folder), "invoices", item, key % 2 == 0)


def estimate_pages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    options = _times(
        _number("o_orderkey", 4),
        lambda i: F.struct(
            F.concat_ws("-", key, i).alias("id"),
            F.concat(F.lit("Option "), i.cast("string")).alias("name"),
            i.cast("string").alias("option_number"),
            (F.floor("o_totalprice") + i).alias("total_amount"),
            F.when(i == 1, "approved").alias("approval_status"),
            F.when(i == 2, "declined").alias("status"),
        ),
    )
    crew = _times(
        _number("o_orderkey", 3), lambda i: F.struct(((key + i) % 40).alias("id"))
    )
    item = F.struct(
        F.concat(F.lit("est_"), key.cast("string")).alias("id"),
        F.col("o_orderpriority").alias("lead_source"),
        _day("o_orderdate").alias("created_at"),
        F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        options.alias("options"),
        crew.alias("assigned_employees"),
    )
    return _page(_orders(spark, folder), "estimates", item, key % 2 == 1)


def people_pages(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """Customers or employees, ids as JSON numbers."""
    prepare(spark)
    table, key, name = {
        "customers": ("customer", "c_custkey", "c_name"),
        "employees": ("supplier", "s_suppkey", "s_name"),
    }[entity]
    parts = F.split(name, "#")
    item = F.struct(F.col(key).alias("id"), parts[0].alias("first_name"), parts[1].alias("last_name"))
    return _page(given(spark, folder, table), entity, item, F.col(key) % 2 == 0)


def pricebook_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Both page shapes; every fifth service has an id but no uuid, every tenth neither."""
    prepare(spark)
    key = F.col("p_partkey")
    item = F.struct(
        F.when(key % 5 != 0, F.concat(F.lit("u"), key.cast("string"))).alias("uuid"),
        F.when(key % 10 != 0, F.concat(F.lit("i"), key.cast("string"))).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_size").cast("double").alias("price"),
        F.when(key % 3 == 0, F.struct(F.col("p_type").alias("name"))).alias("category"),
        F.when(key % 4 == 0, "HVAC").alias("industry_name"),
        (key % 2 == 0).alias("taxable"),
    )
    items, number = F.array(item), (key + 1).cast("int")
    listed = F.struct(items.alias("data"), number.alias("page"), F.lit(9000).alias("total_pages"))
    page = F.struct(
        F.when(key % 2 == 0, F.array(listed)).alias("checklists"),
        F.when(key % 2 == 1, items).alias("data"),
        F.when(key % 2 == 1, number).alias("page"),
        F.when(key % 2 == 1, 8000).alias("total_pages_count"),
    )
    return spread(given(spark, folder, "part")).select(F.to_json(page).alias("page"))


def _items(pages: DataFrame, entity: str) -> DataFrame:
    return page_items(parse_pages(pages, "page", entity), entity)


def _shown(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# ---- flatteners ------------------------------------------------------------


def flatten_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job headers with the appointment counts of their details."""
    jobs = flatten.jobs(_items(job_pages(spark, folder), "jobs"))
    counts = flatten.appointment_counts(_items(detail_pages(spark, folder), "job_details"))
    return flatten.with_appointment_counts(jobs, counts).select(
        "job_id", "customer_id", "work_status", "total_amount", "tags", "num_appointments",
        _shown("completed_at"), _shown("updated_at"), _shown("scheduled_start"), _shown("scheduled_end"),
    )


def details_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Only completed jobs have their details fetched; all others get 0 appointments."""
    jobs = flatten.jobs(_items(job_pages(spark, folder), "jobs"))
    details = _items(detail_pages(spark, folder), "job_details")
    wanted = flatten.jobs_wanting_details(jobs)
    fetched = details.join(wanted, details["id"] == wanted["job_id"], "left_semi")
    return flatten.with_appointment_counts(jobs, flatten.appointment_counts(fetched)).select("job_id", "num_appointments")


def column_added_later(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table whose files of odd invoices were written before the amount was a column."""
    path = shared_folder(spark, "added")
    rows = flatten.invoices(_items(invoice_pages(spark, folder), "invoices"))
    old = F.col("invoice_id").cast("bigint") % 2 == 1
    rows.filter(old).select("invoice_id", "status").write.mode("append").parquet(f"{path}/invoices")
    rows.filter(~old).select("invoice_id", "status", "amount").write.mode("append").parquet(f"{path}/invoices")
    found = Tables(spark, lambda name: spark.read.schema("invoice_id string, status string, amount bigint").parquet(f"{path}/{name}"))
    return found["invoices"].select("invoice_id", "status", "amount", "due_at").withColumn("due_at", F.col("due_at").cast("string"))


def flatten_job_employees(spark: SparkSession, folder: str) -> DataFrame:
    crew = flatten.job_employees(_items(job_pages(spark, folder), "jobs"))
    return crew.select("job_id", "employee_id", "first_name", "role")


def flatten_appointments(spark: SparkSession, folder: str) -> DataFrame:
    visits = flatten.job_appointments(_items(detail_pages(spark, folder), "job_details"))
    return visits.select(
        "job_id", "appointment_id", "anytime", "arrival_window_minutes", "dispatched_employee_id",
        _shown("start_time"), _shown("end_time"),
    )


def flatten_invoices(spark: SparkSession, folder: str) -> DataFrame:
    invoices = flatten.invoices(_items(invoice_pages(spark, folder), "invoices"))
    return invoices.select("invoice_id", "job_id", "status", "amount", _shown("invoice_date"))


def flatten_invoice_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = flatten.invoice_items(_items(invoice_pages(spark, folder), "invoices"))
    return lines.select("invoice_id", "job_id", "item_id", "name", "qty_in_hundredths", "amount")


def flatten_estimates(spark: SparkSession, folder: str) -> DataFrame:
    estimates = flatten.estimates(_items(estimate_pages(spark, folder), "estimates"))
    return estimates.select("estimate_id", "lead_source", "customer_id", _shown("created_at"))


def flatten_estimate_options(spark: SparkSession, folder: str) -> DataFrame:
    options = flatten.estimate_options(_items(estimate_pages(spark, folder), "estimates"))
    return options.select(
        "option_id", "estimate_id", "name", "option_number", "total_amount", "status", "approval_status"
    )


def flatten_estimate_employees(spark: SparkSession, folder: str) -> DataFrame:
    crew = flatten.estimate_employees(_items(estimate_pages(spark, folder), "estimates"))
    return crew.select("estimate_id", "employee_id")


def flatten_customers(spark: SparkSession, folder: str) -> DataFrame:
    people = flatten.customers(_items(people_pages(spark, folder, "customers"), "customers"))
    return people.select("customer_id", "first_name", "last_name", "email")


def flatten_employees(spark: SparkSession, folder: str) -> DataFrame:
    people = flatten.employees(_items(people_pages(spark, folder, "employees"), "employees"))
    return people.select("employee_id", "first_name", "last_name", "role")


def pricebook_services(spark: SparkSession, folder: str) -> DataFrame:
    services = flatten.pricebook_services(_items(pricebook_pages(spark, folder), "pricebook_services"))
    return services.select("service_uuid", "name", "price", "category_name", "industry_name", "taxable", "duration")


def pricebook_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Page counters of either shape."""
    pages = parse_pages(pricebook_pages(spark, folder), "page", "pricebook_services")
    return page_envelope(pages, "pricebook_services").select(
        "page", "total_pages", F.size("items").alias("n_items")
    )


PAGE_SIZE = 100


def numbered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in pages of up to 100 jobs, by day of the pull (one of three); a page has its items and counters under either name.

    The page of an order follows from its key, so a page has at most 100 of them. (pull, page_number, page)
    """
    key = F.col("o_orderkey")
    number = (F.floor(key / PAGE_SIZE) + 1).cast("int")
    item = F.struct(F.concat(F.lit("job_"), key.cast("string")).alias("id"), F.col("o_orderpriority").alias("description"))
    rows = _orders(spark, folder).select((key % 3).cast("int").alias("pull"), number.alias("number"), item.alias("item"))
    filled = rows.groupBy("pull", "number").agg(F.array_sort(F.collect_list("item")).alias("items"))
    last = filled.groupBy("pull").agg(F.max("number").alias("last"))
    own_key = F.col("number") % 2 == 0
    page = F.struct(
        F.when(own_key, F.col("items")).alias("jobs"), F.when(~own_key, F.col("items")).alias("data"), F.col("number").alias("page"),
        F.when(own_key, F.col("last")).alias("total_pages"), F.when(~own_key, F.col("last")).alias("total_pages_count"),
    )
    return filled.join(last, "pull").select("pull", F.col("number").alias("page_number"), F.to_json(page).alias("page"))


def _parsed(pages: DataFrame, entity: str, *more: str) -> DataFrame:
    """Parsed pages beside some columns."""
    return pages.select(*more, F.from_json("page", page_schema(entity)).alias("parsed")).select(*more, "parsed.*")


def paged_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of all pages of several items, with the counters of their pages."""
    pages = parse_pages(numbered_pages(spark, folder), "page", "jobs")
    counted = page_envelope(pages, "jobs").select("page", "total_pages", F.explode("items").alias("item"))
    return counted.select("page", "total_pages", F.col("item.id").alias("job_id"), F.col("item.description").alias("description"))


def pages_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh page never landed; the last page of a pull always did."""
    pages = numbered_pages(spark, folder)
    last = F.max("page_number").over(Window.partitionBy("pull"))
    landed = pages.withColumn("last", last).filter((F.col("page_number") % 7 != 3) | (F.col("page_number") == F.col("last")))
    return missing_pages(_parsed(landed, "jobs", "pull"), ["pull"])


# ---- upserts ---------------------------------------------------------------

EARLY, LATE = "2024-01-20", "2024-01-10"


def _event_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and a batch that overlaps it, both by (user, kind of event)."""
    events = given(prepare(spark), folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    target = events.filter(F.col("ts") < F.lit(EARLY).cast("timestamp_ntz"))
    incoming = events.filter(F.col("ts") >= F.lit(LATE).cast("timestamp_ntz"))
    return target, incoming


def _event_rows(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_type", "event_id", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("happened"))


def dedupe_latest(spark: SparkSession, folder: str) -> DataFrame:
    events, _ = _event_batches(spark, folder)
    return _event_rows(latest_per_key(events, ["user_id", "event_type"], newest=["ts", "event_id"]))


def upsert_plain_key(spark: SparkSession, folder: str) -> DataFrame:
    target, incoming = _event_batches(spark, folder)
    keys, newest = ["user_id", "event_type"], ["ts", "event_id"]
    return _event_rows(upsert(latest_per_key(target, keys, newest=newest), incoming, keys, newest=newest))


def upsert_null_safe_key(spark: SparkSession, folder: str) -> DataFrame:
    """As above, but errors have no kind: NULL in the key is a value like any other."""
    target, incoming = (
        df.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
        for df in _event_batches(spark, folder)
    )
    keys, nullable, newest = ["user_id"], ["event_type"], ["ts", "event_id"]
    stored = latest_per_key(target, keys, nullable, newest)
    return _event_rows(upsert(stored, incoming, keys, nullable, newest))


def upsert_null_key_kept(spark: SparkSession, folder: str) -> DataFrame:
    """NULL in a plain key matches nothing: stored rows with it stay, the batch adds its own."""
    target, incoming = (
        df.withColumn("user_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
        for df in _event_batches(spark, folder)
    )
    keys, newest = ["user_id", "event_type"], ["ts", "event_id"]
    return _event_rows(upsert(target, incoming, keys, newest=newest))


def upsert_keep_newest(spark: SparkSession, folder: str) -> DataFrame:
    """The stored row stays where it is newer than the one that comes in late."""
    late, stored = _event_batches(spark, folder)
    keys, newest = ["user_id", "event_type"], ["ts", "event_id"]
    kept = latest_per_key(stored, keys, newest=newest)
    return _event_rows(upsert(kept, late, keys, newest=newest, keep_newest=True))


def upsert_replace_children(spark: SparkSession, folder: str) -> DataFrame:
    """All stored rows of a user that occurs in the batch make way for the batch, which holds users whole."""
    target, incoming = _event_batches(spark, folder)
    keys, newest = ["user_id", "event_type"], ["ts", "event_id"]
    stored = latest_per_key(target, keys, newest=newest)
    return _event_rows(upsert(stored, incoming, keys, newest=newest, replace_children_of=["user_id"]))


# ---- loads -----------------------------------------------------------------


def _customer_pages(spark: SparkSession, folder: str, first: bool) -> DataFrame:
    """Events as customer records: one per user and event, the newest counts."""
    target, incoming = _event_batches(spark, folder)
    rows = target if first else incoming
    item = F.struct(
        F.concat_ws("-", "user_id", "event_type").alias("id"),
        F.col("event_id").alias("first_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("updated_at"),
    )
    return _page(rows, "customers", item, F.col("event_id") % 2 == 0)


# Pages in one landed file at most; a compressed file is read by one task.
PAGES_PER_FILE = 500_000


def _land(pages: DataFrame, landing: str, entity: str, files: int = 1) -> None:
    """Write pages one per line: as so many plain files where the number matters, else compressed, as most of a page is names."""
    if files > 1:
        pages.repartition(files).write.mode("append").text(f"{landing}/{entity}")
    else:
        pages.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_FILE).text(f"{landing}/{entity}")


def upsert_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The late half lands first and in several micro-batches; the newest record of each key is left."""
    base = shared_folder(spark, "feed")
    landing = f"{base}/landing"
    for first in (False, True):
        _land(_customer_pages(spark, folder, first), landing, "customers", files=4)
        query = start_feed(
            spark, landing, f"{base}/warehouse", "customers", f"{base}/checkpoint", 2, one_per_line=True
        )
        query.awaitTermination()
    loaded = Warehouse(spark, f"{base}/warehouse").tables()["customers"]
    return loaded.select(
        "customer_id", "first_name", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")
    )


def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer record lands three times, and every third one a fourth time with another name: (customer_id, times written, last name written)."""
    base = shared_folder(spark, "changes")
    pages = people_pages(spark, folder, "customers")
    digit = F.regexp_extract("page", "\"id\":([0-9]+)", 1).cast("bigint")
    changed = pages.filter(digit % 3 == 0).select(F.replace("page", F.lit("Customer"), F.lit("Client")).alias("page"))
    for texts in (pages, pages, pages, changed):
        _land(texts, f"{base}/landing", "customers")
        stream = with_file_arrival(spark.readStream.schema(page_schema("customers")).json(f"{base}/landing/customers"))
        found = changes(as_records(page_items(stream, "customers"), "customers"))
        query = found.writeStream.format("parquet").option("path", f"{base}/written").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    written = as_items(spark.read.schema("key string, version string, arrived string, record string").parquet(f"{base}/written"), "customers")
    return written.groupBy(F.col("id").alias("customer_id")).agg(F.count("*").alias("times_written"), F.max_by("first_name", ARRIVED).alias("last_name_written"))


def load_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A full load, then an incremental one of the same files: (table, rows) afterwards."""
    return table_counts(_loaded_twice(spark, folder), LOADED)


def load_twice_values(spark: SparkSession, folder: str) -> DataFrame:
    """The same loads: values afterwards."""
    return _shown_values(_loaded_twice(spark, folder))


def _loaded_twice(spark: SparkSession, folder: str) -> Tables:
    base = shared_folder(spark, "load")
    landing, warehouse = f"{base}/landing", f"{base}/warehouse"
    _land(job_pages(spark, folder), landing, "jobs")
    _land(detail_pages(spark, folder), landing, "job_details")
    _land(invoice_pages(spark, folder), landing, "invoices")
    _land(estimate_pages(spark, folder), landing, "estimates")
    _land(people_pages(spark, folder, "customers"), landing, "customers")
    _land(people_pages(spark, folder, "employees"), landing, "employees")
    _land(pricebook_pages(spark, folder), landing, "pricebook_services")
    _land(material_pages(spark, folder), landing, "pricebook_materials")
    at = datetime.fromisoformat(AS_OF)
    load_all(spark, landing, warehouse, at, backfill=True, one_per_line=True)
    load_all(spark, landing, warehouse, at + timedelta(hours=2), one_per_line=True)
    return Warehouse(spark, warehouse).tables()


def material_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth material has an id but no uuid."""
    prepare(spark)
    key = F.col("p_partkey")
    item = F.struct(
        F.when(key % 5 != 0, F.concat(F.lit("u"), key.cast("string"))).alias("uuid"),
        F.concat(F.lit("i"), key.cast("string")).alias("id"),
        F.concat(F.lit("Stock "), F.col("p_name")).alias("name"),
        F.col("p_size").cast("double").alias("cost"),
    )
    return _page(given(spark, folder, "part"), "pricebook_materials", item, key < 0)


# Words in the pages of the older day and what stands for them on the newer one.
RESENT = {
    "in progress": "scheduled", "Tech ": "Lead ", '"open"': '"paid"', "Part ": "Piece ", "Option ": "Choice ",
    "Customer": "Client", "Supplier": "Vendor", "Stock ": "Item ", '"arrival_window_minutes":30': '"arrival_window_minutes":45',
}


def load_resent(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity landed on two days with other values, most without a time of change; the newer day's files are written first."""
    base = shared_folder(spark, "resent")
    pages = {
        "jobs": job_pages(spark, folder), "job_details": detail_pages(spark, folder), "invoices": invoice_pages(spark, folder),
        "estimates": estimate_pages(spark, folder), "customers": people_pages(spark, folder, "customers"),
        "employees": people_pages(spark, folder, "employees"), "pricebook_materials": material_pages(spark, folder),
    }
    for day in ("2001-08-01", "2001-07-31"):
        for entity, texts in pages.items():
            text = F.col("page")
            for old, new in RESENT.items() if day == "2001-08-01" else ():
                text = F.replace(text, F.lit(old), F.lit(new))
            _land(texts.select(text.alias("page")), f"{base}/landing", f"{entity}/load_date={day}")
    load_all(spark, f"{base}/landing", f"{base}/warehouse", datetime.fromisoformat(AS_OF), backfill=True, one_per_line=True)
    return _shown_values(Warehouse(spark, f"{base}/warehouse").tables())


def _shown_values(tables: Tables) -> DataFrame:
    """(table_name, key, value) of one telling column of each table."""
    shown = {
        "jobs": ("job_id", "work_status"), "job_employees": ("concat_ws(' ', job_id, employee_id)", "first_name"),
        "job_appointments": ("concat_ws(' ', appointment_id, dispatched_employee_id)", "cast(arrival_window_minutes AS string)"),
        "invoices": ("invoice_id", "status"), "invoice_items": ("concat_ws(' ', invoice_id, item_id)", "name"),
        "estimate_options": ("option_id", "name"), "customers": ("customer_id", "first_name"), "employees": ("employee_id", "first_name"),
        "pricebook_materials": ("material_uuid", "name"),
    }
    rows = [tables[t].selectExpr(f"'{t}' AS table_name", f"{key} AS key", f"{value} AS value") for t, (key, value) in shown.items()]
    return reduce(DataFrame.unionByName, rows)


LOADED = (
    "jobs", "job_employees", "job_appointments", "invoices", "invoice_items", "estimates",
    "estimate_options", "estimate_employees", "customers", "employees", "pricebook_services", "load_log",
)

QUERIES = {
    f.__name__: f
    for f in (
        flatten_jobs, flatten_job_employees, flatten_appointments, flatten_invoices, flatten_invoice_items,
        flatten_estimates, flatten_estimate_options, flatten_estimate_employees, flatten_customers,
        flatten_employees, pricebook_services, pricebook_envelope, dedupe_latest, upsert_plain_key,
        upsert_null_safe_key, upsert_null_key_kept, upsert_keep_newest, upsert_replace_children,
        upsert_stream, load_twice, load_twice_values, load_resent, details_missing, column_added_later, paged_items, pages_missing, stream_changes,
    )
}

# ---- SQL -------------------------------------------------------------------

_STAMP = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_N = {n: f"unnest(generate_series(1, o_orderkey % {n}))::BIGINT AS i" for n in (3, 4)}


def _latest(source: str, keys: str = "user_id, event_type") -> str:
    return f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
        PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) AS place FROM {source}) WHERE place = 1"""


def _events_sql(body: str, kind: str = "event_type", user: str = "user_id") -> str:
    columns = f"event_id, ts, {user} AS user_id, {kind} AS event_type, value"
    return f"""WITH e AS (SELECT {columns} FROM events),
        target AS (SELECT * FROM e WHERE ts < TIMESTAMP '{EARLY}'),
        incoming AS (SELECT * FROM e WHERE ts >= TIMESTAMP '{LATE}'),
        stored AS ({_latest('target')}), batch AS ({_latest('incoming')}), merged AS ({body})
        SELECT user_id, event_type, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS happened FROM merged"""


_NO_KIND = "CASE WHEN event_type <> 'error' THEN event_type END"
_NO_USER = "CASE WHEN user_id % 3 <> 0 THEN user_id END"
_SAME = "b.user_id = s.user_id AND b.event_type IS NOT DISTINCT FROM s.event_type"

SQL = {
    "flatten_jobs": f"""SELECT 'job_' || o_orderkey AS job_id, o_custkey::VARCHAR AS customer_id,
          CASE WHEN o_orderstatus = 'F' THEN 'complete rated' ELSE 'in progress' END AS work_status,
          floor(o_totalprice / 5)::BIGINT AS total_amount,
          CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority || ',Residential' END AS tags,
          CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 4 ELSE 0 END::INTEGER AS num_appointments,
          CASE WHEN o_orderstatus = 'F' THEN {_STAMP} END AS completed_at, {_STAMP} AS updated_at,
          {_STAMP} AS scheduled_start, NULL::VARCHAR AS scheduled_end FROM orders""",
    "flatten_job_employees": f"""SELECT 'job_' || o_orderkey AS job_id, 'pro_' || ((o_orderkey + i) % 50) AS employee_id,
          'Tech ' || i AS first_name, CASE WHEN i > 1 THEN 'field tech' END AS role
        FROM (SELECT o_orderkey, {_N[4]} FROM orders)""",
    "flatten_appointments": f"""WITH visits AS (
          SELECT o_orderkey, {_STAMP} AS stamp, {_N[4]} FROM orders WHERE o_orderkey % 8 <> 0),
        sent AS (SELECT *, unnest(CASE WHEN (o_orderkey + i) % 3 = 0 THEN [NULL]
          ELSE generate_series(1, (o_orderkey + i) % 3) END)::BIGINT AS j FROM visits)
        SELECT 'job_' || o_orderkey AS job_id, o_orderkey || '-' || i AS appointment_id, i = 1 AS anytime,
          (i * 30)::INTEGER AS arrival_window_minutes, 'pro_' || (j * 10 + i) AS dispatched_employee_id,
          stamp AS start_time, NULL::VARCHAR AS end_time FROM sent""",
    "flatten_invoices": f"""SELECT o_orderkey::VARCHAR AS invoice_id,
          CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey + 1)::VARCHAR END AS job_id, 'open' AS status,
          floor(o_totalprice)::BIGINT AS amount, {_STAMP} AS invoice_date FROM orders""",
    "flatten_invoice_items": f"""SELECT o_orderkey::VARCHAR AS invoice_id,
          CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey + 1)::VARCHAR END AS job_id,
          CASE WHEN i = 1 THEN 'line_' || o_orderkey END AS item_id, 'Part ' || i AS name,
          (i * 100)::INTEGER AS qty_in_hundredths, floor(o_totalprice)::BIGINT * i AS amount
        FROM (SELECT o_orderkey, o_totalprice, {_N[3]} FROM orders)""",
    "flatten_estimates": f"""SELECT 'est_' || o_orderkey AS estimate_id, o_orderpriority AS lead_source,
          o_custkey::VARCHAR AS customer_id, {_STAMP} AS created_at FROM orders""",
    "flatten_estimate_options": f"""SELECT o_orderkey || '-' || i AS option_id, 'est_' || o_orderkey AS estimate_id,
          'Option ' || i AS name, i::VARCHAR AS option_number, floor(o_totalprice)::BIGINT + i AS total_amount,
          CASE WHEN i = 2 THEN 'declined' END AS status, CASE WHEN i = 1 THEN 'approved' END AS approval_status
        FROM (SELECT o_orderkey, o_totalprice, {_N[4]} FROM orders)""",
    "flatten_estimate_employees": f"""SELECT 'est_' || o_orderkey AS estimate_id,
          ((o_orderkey + i) % 40)::VARCHAR AS employee_id FROM (SELECT o_orderkey, {_N[3]} FROM orders)""",
    "flatten_customers": """SELECT c_custkey::VARCHAR AS customer_id, split_part(c_name, '#', 1) AS first_name,
          split_part(c_name, '#', 2) AS last_name, NULL::VARCHAR AS email FROM customer""",
    "flatten_employees": """SELECT s_suppkey::VARCHAR AS employee_id, split_part(s_name, '#', 1) AS first_name,
          split_part(s_name, '#', 2) AS last_name, NULL::VARCHAR AS role FROM supplier""",
    "pricebook_services": """SELECT CASE WHEN p_partkey % 5 <> 0 THEN 'u' ELSE 'i' END || p_partkey AS service_uuid,
          p_name AS name, p_size::DOUBLE AS price, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS category_name,
          CASE WHEN p_partkey % 4 = 0 THEN 'HVAC' END AS industry_name, p_partkey % 2 = 0 AS taxable,
          NULL::INTEGER AS duration FROM part WHERE p_partkey % 10 <> 0""",
    "pricebook_envelope": """SELECT (p_partkey + 1)::INTEGER AS page,
          CASE WHEN p_partkey % 2 = 0 THEN 9000 ELSE 8000 END AS total_pages, 1 AS n_items FROM part""",
    "dedupe_latest": _events_sql("SELECT * FROM stored"),
    "upsert_plain_key": _events_sql(
        f"SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE {_SAME}) UNION ALL SELECT * FROM batch"
    ),
    "upsert_null_safe_key": _events_sql(
        f"SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE {_SAME}) UNION ALL SELECT * FROM batch",
        kind=_NO_KIND,
    ),
    "upsert_null_key_kept": _events_sql(
        f"SELECT * FROM target s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE {_SAME}) UNION ALL SELECT * FROM batch",
        user=_NO_USER,
    ),
    "upsert_keep_newest": _events_sql(_latest("(SELECT * FROM target UNION ALL SELECT * FROM incoming)")),
    "upsert_replace_children": _events_sql(
        """SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.user_id = s.user_id)
           UNION ALL SELECT * FROM batch"""
    ),
    "upsert_stream": f"""SELECT user_id || '-' || event_type AS customer_id, event_id::VARCHAR AS first_name,
          strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated FROM ({_latest('events')})""",
    "details_missing": """SELECT 'job_' || o_orderkey AS job_id,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 8 <> 0 THEN o_orderkey % 4 ELSE 0 END::INTEGER AS num_appointments FROM orders""",
    "column_added_later": """SELECT o_orderkey::VARCHAR AS invoice_id, 'open' AS status,
          CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT END AS amount, NULL::VARCHAR AS due_at FROM orders""",
    "load_resent": f"""SELECT 'jobs' AS table_name, 'job_' || o_orderkey AS key,
          CASE WHEN o_orderstatus = 'F' THEN 'complete rated' ELSE 'scheduled' END AS value FROM orders
        UNION ALL SELECT 'job_employees', 'job_' || o_orderkey || ' pro_' || ((o_orderkey + i) % 50), 'Lead ' || i
          FROM (SELECT o_orderkey, {_N[4]} FROM orders)
        UNION ALL SELECT 'job_appointments', o_orderkey || '-' || i || coalesce(' pro_' || (j * 10 + i), ''),
          CASE WHEN i = 1 THEN '45' ELSE (i * 30)::VARCHAR END
          FROM (SELECT *, unnest(CASE WHEN (o_orderkey + i) % 3 = 0 THEN [NULL] ELSE generate_series(1, (o_orderkey + i) % 3) END)::BIGINT AS j
            FROM (SELECT o_orderkey, {_N[4]} FROM orders WHERE o_orderkey % 8 <> 0))
        UNION ALL SELECT 'invoices', o_orderkey::VARCHAR, 'paid' FROM orders
        UNION ALL SELECT 'invoice_items', o_orderkey || CASE WHEN i = 1 THEN ' line_' || o_orderkey ELSE '' END, 'Piece ' || i
          FROM (SELECT o_orderkey, {_N[3]} FROM orders)
        UNION ALL SELECT 'estimate_options', o_orderkey || '-' || i, 'Choice ' || i FROM (SELECT o_orderkey, {_N[4]} FROM orders)
        UNION ALL SELECT 'customers', c_custkey::VARCHAR, replace(split_part(c_name, '#', 1), 'Customer', 'Client') FROM customer
        UNION ALL SELECT 'employees', s_suppkey::VARCHAR, replace(split_part(s_name, '#', 1), 'Supplier', 'Vendor') FROM supplier
        UNION ALL SELECT 'pricebook_materials', CASE WHEN p_partkey % 5 <> 0 THEN 'u' ELSE 'i' END || p_partkey, 'Item ' || p_name FROM part""",
    "load_twice": f"""SELECT 'jobs' AS table_name, count(*) AS row_count FROM orders
        UNION ALL SELECT 'job_employees', count(*) FROM (SELECT {_N[4]} FROM orders)
        UNION ALL SELECT 'job_appointments', sum(greatest(1, (o_orderkey + i) % 3))::BIGINT
          FROM (SELECT o_orderkey, {_N[4]} FROM orders WHERE o_orderkey % 8 <> 0)
        UNION ALL SELECT 'invoices', count(*) FROM orders
        UNION ALL SELECT 'invoice_items', count(*) FROM (SELECT {_N[3]} FROM orders)
        UNION ALL SELECT 'estimates', count(*) FROM orders
        UNION ALL SELECT 'estimate_options', count(*) FROM (SELECT {_N[4]} FROM orders)
        UNION ALL SELECT 'estimate_employees', count(*) FROM (SELECT {_N[3]} FROM orders)
        UNION ALL SELECT 'customers', count(*) FROM customer
        UNION ALL SELECT 'employees', count(*) FROM supplier
        UNION ALL SELECT 'pricebook_services', count(*) FROM part WHERE p_partkey % 10 <> 0
        UNION ALL SELECT 'load_log', 6""",
}

# The values of the second load are those of the pages, before any word is replaced.
SQL["load_twice_values"] = reduce(
    lambda text, pair: text.replace(*pair),
    [
        ("ELSE 'scheduled' END", "ELSE 'in progress' END"), ("'Lead '", "'Tech '"), ("'paid'", "'open'"), ("'Piece '", "'Part '"), ("'Choice '", "'Option '"),
        ("replace(split_part(c_name, '#', 1), 'Customer', 'Client')", "split_part(c_name, '#', 1)"), ("replace(split_part(s_name, '#', 1), 'Supplier', 'Vendor')", "split_part(s_name, '#', 1)"),
        ("'Item '", "'Stock '"), ("THEN '45'", "THEN '30'"),
    ],
    SQL["load_resent"],
)
_PAGES = """WITH pages AS (SELECT o_orderkey % 3 AS pull, o_orderkey // 100 + 1 AS page, o_orderkey, o_orderpriority FROM orders),
    lasts AS (SELECT pull, max(page) AS total_pages FROM pages GROUP BY pull)"""
SQL["stream_changes"] = """SELECT c_custkey::VARCHAR AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS times_written,
    CASE WHEN c_custkey % 3 = 0 THEN replace(split_part(c_name, '#', 1), 'Customer', 'Client') ELSE split_part(c_name, '#', 1) END AS last_name_written FROM customer"""
SQL["paged_items"] = f"""{_PAGES} SELECT page::INTEGER AS page, total_pages::INTEGER AS total_pages, 'job_' || o_orderkey AS job_id,
    o_orderpriority AS description FROM pages JOIN lasts USING (pull)"""
SQL["pages_missing"] = f"""{_PAGES}, every AS (SELECT pull, total_pages, unnest(generate_series(1, total_pages)) AS page FROM lasts)
    SELECT e.pull::INTEGER AS pull, e.page::INTEGER AS page, e.total_pages::INTEGER AS total_pages FROM every e
    WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.pull = e.pull AND p.page = e.page AND (p.page % 7 <> 3 OR p.page = e.total_pages))"""
