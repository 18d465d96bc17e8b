"""Landing folder -> warehouse as a file stream.

Each micro-batch is upserted by key and the newer row wins, by its time of change and then by the time its file was
written, so late and re-sent records, replayed batches and any order of files lead to the same tables. One
stream per entity; the checkpoint remembers which files are done. Streams of several entities may run side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from wrenchlight.operators.flatten import FLATTENERS
from wrenchlight.session import prepare
from wrenchlight.sources.landing import page_items, page_schema, with_file_arrival
from wrenchlight.sources.warehouse import Warehouse
from wrenchlight.streaming.changes import as_items, as_records, changes


def apply_items(warehouse: Warehouse, entity: str, found: DataFrame) -> None:
    """Upsert items into all tables of the entity."""
    items = warehouse.staged_items(entity, found)
    for name, flatten in FLATTENERS[entity].items():
        warehouse.upsert(name, flatten(items))
    warehouse.drop_staged()


def start_feed(
    spark: SparkSession,
    landing: str,
    warehouse_root: str,
    entity: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    one_per_line: bool = False,
    only_changes: bool = False,
) -> StreamingQuery:
    """Load everything that has landed for ``entity`` and stop; run it again for what lands later.

    only_changes: keep the newest version of each record as state, and write only records that are newer and differ (see ``changes``).
    """
    prepare(spark)
    warehouse = Warehouse(spark, warehouse_root)
    pages = with_file_arrival(
        spark.readStream.schema(page_schema(entity))
        .option("multiLine", not one_per_line)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(f"{landing}/{entity}")
    )
    if only_changes:
        rows, items_of = changes(as_records(page_items(pages, entity), entity)), lambda batch: as_items(batch, entity)
    else:
        rows, items_of = pages, lambda batch: page_items(batch, entity)
    return (
        rows.writeStream.foreachBatch(lambda batch, _: apply_items(warehouse, entity, items_of(batch)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
