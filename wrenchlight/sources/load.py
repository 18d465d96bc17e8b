"""One load: read what has landed, flatten, upsert, note the window."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession

from wrenchlight.functions.times import instant
from wrenchlight.operators.flatten import FLATTENERS, jobs_wanting_details
from wrenchlight.plans.freshness import latest_facts, refresh_due
from wrenchlight.session import folder_bytes, prepare
from wrenchlight.sources.landing import INCREMENTAL, LOOK_BACK, read_items, require_all_pages
from wrenchlight.sources.warehouse import Warehouse


# Tables of one load that are written at the same time.
PARALLEL_TABLES = 4


def load_log_rows(spark: SparkSession, as_of: datetime, window: timedelta, finished: datetime) -> DataFrame:
    """The three facts kept about a load, as key/value rows."""
    facts = [
        ("last_window_start", (as_of - window).isoformat()),
        ("last_window_end", as_of.isoformat()),
        ("last_refresh", finished.isoformat()),
    ]
    rows = spark.createDataFrame(facts, "key string, value string")
    return rows.withColumn("recorded_at", instant(finished))


def load_all(
    spark: SparkSession,
    landing: str,
    warehouse_root: str,
    as_of: datetime | None = None,
    window: timedelta = LOOK_BACK,
    backfill: bool = False,
    min_interval: timedelta = timedelta(hours=1),
    one_per_line: bool = False,
    replace_children: bool = False,
    wanted_details_only: bool = False,
    all_pages: bool = False,
) -> bool:
    """Bring the warehouse up to date with the landing folder. False if it is too early.

    Estimates, jobs, their details, customers and invoices are read as far back as ``window``
    unless ``backfill``; the rest is read whole. Landing folders by day of arrival
    let the scan skip the files of earlier days. The newer record of a key wins: by its time of
    change where it has one, then by arrival, whatever the order of files. Loading the same files again changes nothing.
    The window is noted last, so a load that died is repeated.

    wanted_details_only: of the landed details take only those of completed jobs of this batch.
    all_pages: raise ``PagesMissing``, and load nothing, if a pull announced pages that have not landed.
    """
    prepare(spark, folder_bytes(spark, landing))
    as_of = as_of or datetime.now(timezone.utc)
    warehouse = Warehouse(spark, warehouse_root)
    facts = latest_facts(warehouse.tables()["load_log"])
    if min_interval and not refresh_due(facts, instant(as_of), min_interval).first().due:
        return False

    def since_of(entity: str) -> Column | None:
        return None if backfill or entity not in INCREMENTAL else instant(as_of - window)

    if all_pages:
        for entity in FLATTENERS:
            require_all_pages(spark, landing, entity, one_per_line, since_of(entity))

    def landed(entity: str) -> DataFrame:
        since = since_of(entity)
        return warehouse.staged_items(entity, read_items(spark, landing, entity, one_per_line, since))

    # Entities do not depend on each other; side by side, small tables fill the gaps of large ones.
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        items = dict(zip(FLATTENERS, pool.map(landed, FLATTENERS)))
        batches = {name: flatten(items[entity]) for entity, tabs in FLATTENERS.items() for name, flatten in tabs.items()}
        if wanted_details_only:
            wanted = jobs_wanting_details(batches["jobs"]).distinct()
            batches["job_appointments"] = batches["job_appointments"].join(wanted, "job_id", "left_semi")
        log = load_log_rows(spark, as_of, window, as_of)
        list(pool.map(lambda name: warehouse.upsert(name, batches[name], replace_children), batches))
    warehouse.append("load_log", log)
    warehouse.drop_staged()
    return True
