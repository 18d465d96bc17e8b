"""JSON exports: pages of nested items, as landed by whatever fetches them.

A page is an envelope with an item array under the entity's own name or under
``data`` (price books also under ``checklists[0].data``) and page counters under
one of two names.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from wrenchlight.functions.times import parse_time
from wrenchlight.schemas import ARRIVED

_PERSON = "id string, first_name string, last_name string, email string, mobile_number string"
_CREW = (
    "array<struct<id:string,first_name:string,last_name:string,email:string,mobile_number:string,"
    "color_hex:string,avatar_url:string,role:string>>"
)
_OPTION = (
    "array<struct<id:string,name:string,option_number:string,total_amount:double,status:string,"
    "approval_status:string,created_at:string,updated_at:string>>"
)
_LINE = (
    "array<struct<id:string,name:string,type:string,qty_in_hundredths:int,unit_cost:double,"
    "unit_price:double,amount:double,description:string>>"
)
_VISIT = (
    "array<struct<id:string,start_time:string,end_time:string,anytime:boolean,"
    "arrival_window_minutes:int,duration_minutes:double,dispatched_employees_ids:array<string>>>"
)
_PERIOD = "struct<scheduled_start:string,scheduled_end:string>"

# Fixed value: how far back an incremental load reads.
LOOK_BACK = timedelta(days=60)

# Item schema of each entity.
ITEMS: dict[str, str] = {
    "jobs": f"""id string, invoice_number string, description string, work_status string,
        total_amount double, outstanding_balance double, subtotal double, tags array<string>,
        created_at string, updated_at string, customer struct<id:string>, schedule {_PERIOD},
        work_timestamps struct<completed_at:string>, assigned_employees {_CREW}""",
    "job_details": f"id string, schedule struct<appointments:{_VISIT}>",
    "customers": f"{_PERSON}, company string, created_at string, updated_at string",
    "invoices": f"""id string, job_id string, invoice_number string, status string, amount double,
        subtotal double, due_amount double, due_at string, paid_at string, sent_at string,
        service_date string, invoice_date string, display_due_concept string, due_concept string,
        items {_LINE}""",
    "employees": f"""{_PERSON}, role string, avatar_url string, color_hex string,
        company_id string, company_name string""",
    "estimates": f"""id string, estimate_number string, work_status string, lead_source string,
        customer struct<id:string>, schedule {_PERIOD}, created_at string, updated_at string,
        company_id string, company_name string, assigned_employees array<struct<id:string>>,
        options {_OPTION}""",
    "pricebook_services": """uuid string, id string, name string, task_number string,
        description string, price double, cost double, duration int, managed_by string,
        flat_rate_enabled boolean, taxable boolean, unit_of_measure string, category_name string,
        industry_name string, category struct<name:string>, industry struct<name:string>,
        updated_at string""",
    "pricebook_materials": """uuid string, id string, name string, part_number string,
        unit_of_measure string, cost double, price double, taxable boolean,
        material_category_name string""",
}

# Names under which a page may hold its items, best first; ``data`` is always tried.
ENVELOPE_KEYS: dict[str, tuple[str, ...]] = {
    "pricebook_services": (),
    "pricebook_materials": (),
    "invoices": ("invoices", "data", "jobs"),
}

# Counters of a page; the number of pages and of items go by two names each.
PAGE_COUNTERS = """page int, page_size int, total_pages int, total_pages_count int,
    total_items bigint, total_count bigint"""

# Landing folders may be partitioned by the day of arrival: landing/jobs/load_date=2026-08-01/…
ARRIVAL = "load_date"

# Entities that a load reads only as far back as its window; the others are read whole.
# Invoices and job details carry no time of change, so for them only the day of arrival can tell.
INCREMENTAL = ("estimates", "jobs", "job_details", "customers", "invoices")


def item_schema(entity: str) -> StructType:
    return StructType.fromDDL(ITEMS[entity])


def envelope_keys(entity: str) -> tuple[str, ...]:
    keys = ENVELOPE_KEYS.get(entity, (entity,))
    return keys if "data" in keys else (*keys, "data")


def page_schema(entity: str) -> StructType:
    items = ArrayType(item_schema(entity))
    checklist = StructType().add("data", items)
    for counter in StructType.fromDDL("page int, page_size int, total_pages int, total_items bigint"):
        checklist = checklist.add(counter)
    schema = StructType()
    for key in envelope_keys(entity):
        schema = schema.add(key, items)
    for counter in StructType.fromDDL(PAGE_COUNTERS):
        schema = schema.add(counter)
    # Job details come one job per page, without an envelope.
    if entity == "job_details":
        for item_field in item_schema(entity).fields:
            schema = schema.add(item_field)
    return schema.add("checklists", ArrayType(checklist))


def with_file_arrival(pages: DataFrame) -> DataFrame:
    """Pages just read from files, with when they arrived: the day of the folder, the time of the file, its name."""
    day = F.date_format(ARRIVAL, "yyyy-MM-dd") if ARRIVAL in pages.columns else F.lit("")
    written = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return pages.withColumn(ARRIVED, F.concat_ws("|", F.coalesce(day, F.lit("")), written, "_metadata.file_name"))


def read_pages(spark: SparkSession, path: str, entity: str, one_per_line: bool = False) -> DataFrame:
    """Pages of an entity from JSON files; a missing folder counts as no pages.

    Unless there is one page per line, a file is read by one task: keep such files to some hundred MB.
    """
    schema = page_schema(entity)
    reader = spark.read.schema(schema).option("multiLine", not one_per_line)
    try:
        return with_file_arrival(reader.json(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.add(ARRIVED, "string"))


def parse_pages(texts: DataFrame, column: str, entity: str) -> DataFrame:
    """Pages from a text column that holds one JSON page per row."""
    page = F.from_json(F.col(column), page_schema(entity))
    return texts.select(page.alias("page")).select("page.*")


def _filled(array: Column) -> Column:
    """The array, or NULL if it has no elements."""
    return F.when(F.size(array) > 0, array)


def page_envelope(pages: DataFrame, entity: str) -> DataFrame:
    """(items, page, page_size, total_pages, total_items) of every page, whichever its shape."""
    listed = [_filled(F.col(key)) for key in envelope_keys(entity)]
    if entity == "job_details":
        single = F.struct(*[F.col(f.name) for f in item_schema(entity).fields])
        listed.append(F.when(F.col("id").isNotNull(), F.array(single)))
    first = F.get("checklists", F.lit(0))
    in_checklists = F.coalesce(F.size("checklists") > 0, F.lit(False))

    def pick(from_checklist: Column, from_page: Column) -> Column:
        return F.when(in_checklists, from_checklist).otherwise(from_page)

    return pages.select(
        pick(_filled(first["data"]), F.coalesce(*listed)).alias("items"),
        pick(first["page"], F.col("page")).alias("page"),
        pick(first["page_size"], F.col("page_size")).alias("page_size"),
        pick(first["total_pages"], F.coalesce("total_pages", "total_pages_count")).alias("total_pages"),
        pick(first["total_items"], F.coalesce("total_items", "total_count")).alias("total_items"),
        *([ARRIVED] if ARRIVED in pages.columns else []),
    )


def page_items(pages: DataFrame, entity: str) -> DataFrame:
    """The items of all pages, one row each.

    ``explode_outer`` and a filter behind it, because ``explode`` makes the optimizer
    test the array below it, and for ``parse_pages`` that means parsing every text
    once more for each mention of the array.
    """
    arrived = ARRIVED in pages.columns
    enveloped = page_envelope(pages, entity).select("items", *([ARRIVED] if arrived else []))
    if not arrived:
        exploded = enveloped.select(F.explode_outer("items").alias("item"))
        return exploded.filter(F.col("item").isNotNull()).select("item.*")
    exploded = enveloped.select(ARRIVED, F.posexplode_outer("items").alias("place", "item"))
    place = F.lpad(F.col("place").cast("string"), 6, "0")
    return exploded.filter(F.col("item").isNotNull()).select("item.*", F.concat_ws("|", ARRIVED, place).alias(ARRIVED))


def missing_pages(pages: DataFrame, pull: Sequence[str] = ()) -> DataFrame:
    """(pull columns, page, total_pages) of the pages that were announced and have not landed.

    A pull announces as many pages as its largest page count says, one if no page says anything. ``pull`` names the columns that tell pulls
    apart, such as the day of arrival. A pull of which no page at all has landed cannot be known.
    """
    seen = _page_counters(pages, pull).select(*pull, F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("total_pages", F.lit(1)).alias("total_pages"))
    announced = seen.groupBy(*pull).agg(F.max("total_pages").alias("total_pages")).filter("total_pages > 0")
    every = announced.withColumn("page", F.explode(F.sequence(F.lit(1), "total_pages")))
    landed = seen.select(*[F.col(c).alias(f"_of_{c}") for c in pull], F.col("page").alias("_page")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in pull]
    return every.join(landed, [F.col("page") == F.col("_page"), *same], "left_anti").select(*pull, "page", "total_pages")


def _page_counters(pages: DataFrame, pull: Sequence[str]) -> DataFrame:
    """The counters of each page beside the columns that name its pull."""
    first = F.get("checklists", F.lit(0))
    inside = F.coalesce(F.size("checklists") > 0, F.lit(False))
    page = F.when(inside, first["page"]).otherwise(F.col("page"))
    total = F.when(inside, first["total_pages"]).otherwise(F.coalesce("total_pages", "total_pages_count"))
    return pages.select(*pull, page.alias("page"), total.alias("total_pages"))


class PagesMissing(RuntimeError):
    """A pull announced pages that have not landed."""


def require_all_pages(spark: SparkSession, landing: str, entity: str, one_per_line: bool = False, since: Column | None = None) -> None:
    """Raise ``PagesMissing`` if a day's pull of the entity is incomplete. Details of jobs come without counters and pass."""
    pages = read_pages(spark, f"{landing}/{entity}", entity, one_per_line)
    pages = pages if since is None else arrived_since(pages, since)
    pull = [ARRIVAL] if ARRIVAL in pages.columns else []
    gone = [r.asDict() for r in missing_pages(pages, pull).orderBy(*pull, "page").limit(5).collect()]
    if gone:
        raise PagesMissing(f"{entity}: pages have not landed, the first are {gone}")


def updated_since(items: DataFrame, since: Column, column: str = "updated_at") -> DataFrame:
    """Only items changed at ``since`` or later; entities without that column are returned whole.

    Items without a readable time of change stay: only the day of arrival can tell about them.
    Text and timestamp columns both work.
    """
    if column not in items.columns:
        return items
    changed = parse_time(column)
    return items.filter((changed >= since) | changed.isNull())


def updated_within(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Only items changed in the ``days`` before ``as_of``; the start of the window is included."""
    return updated_since(items, as_of - F.expr(f"interval {int(days)} days"))


def arrived_since(pages: DataFrame, since: Column) -> DataFrame:
    """Leave out folders of days before ``since``; nothing changed later can have arrived earlier.

    One day is added for clocks and zones. A landing folder without such folders is read whole.
    """
    if ARRIVAL not in pages.columns:
        return pages
    return pages.filter(F.col(ARRIVAL).cast("date") >= F.date_sub(since.cast("date"), 1))


def read_items(
    spark: SparkSession, landing: str, entity: str, one_per_line: bool = False, since: Column | None = None
) -> DataFrame:
    """Items of an entity; with ``since`` only those that arrived and changed from then on."""
    pages = read_pages(spark, f"{landing}/{entity}", entity, one_per_line)
    if since is None:
        return page_items(pages, entity)
    return updated_since(page_items(arrived_since(pages, since), entity), since)
