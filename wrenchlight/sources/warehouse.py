"""Tables as plain Parquet, partitioned by a hash bucket of the key.

A load reads and rewrites just the buckets that its batch touches: the batch is reduced to one row per key, the stored rows of its buckets are
merged with it, the newer row of each key stays, and Spark's dynamic partition overwrite puts the merged buckets in place of the old ones. Rows that decide about one another are
in one bucket: those of a key, and of child tables those of a parent.

The number of buckets of a table is fixed by its first load, from its size, and is written beside the tables. Within a bucket rows are sorted by the date the KPIs filter on, so that
row groups are skipped. With each bucket goes a sketch of the frequent parents in it; sketches of all buckets merge, so that no scan is needed to find them.

One load at a time, and readers open the tables anew after it: files of rewritten buckets are gone. A load that dies leaves each table's old or new buckets; as loading a
record again changes nothing, it is just run again. Where tables have to switch together, the folder belongs under a table format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from wrenchlight.operators.joins import key_sketches
from wrenchlight.operators.upsert import BROADCAST_KEY_ROWS, changed_rows, keyless, put_rows, reduce_batch, upsert_table
from wrenchlight.schemas import TABLES, TableSpec, conform, with_arrival
from wrenchlight.session import folder_bytes, shared_folder
from wrenchlight.sources.tables import Tables, read_parquet_if_present

BUCKET = "key_bucket"
BUCKET_BYTES = 256 << 20
MOST_BUCKETS = 1 << 14


def _whole_parent(spec: TableSpec) -> bool:
    """Whether rows of one key always have one parent, so that a parent's rows can share a bucket."""
    return bool(spec.parent) and set(spec.parent) <= set(spec.full_key)


def _hashed(columns: tuple[str, ...], buckets: int) -> Column:
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.pmod(F.xxhash64(*plain), F.lit(buckets)).cast("int")


def bucket_of(spec: TableSpec, buckets: int) -> Column:
    """The bucket of a row: by parent or key; of a row without a key by its parent, or else by all it says."""
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in spec.keys])
    keyed = _hashed(spec.parent if _whole_parent(spec) else spec.full_key, buckets)
    return F.when(keyless, _hashed(spec.parent or tuple(spec.schema.fieldNames()), buckets)).otherwise(keyed)


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark = spark
        self.root = root.rstrip("/")
        self.bucket_bytes = bucket_bytes
        self._staged: list[str] = []

    # ---- reading -----------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def buckets(self, name: str) -> int | None:
        """The number of buckets of a table, None before its first load."""
        noted = read_parquet_if_present(self.spark, f"{self.root}/_buckets/{name}", "buckets int")
        row = noted.first() if noted is not None else None
        return row.buckets if row else None

    def _read(self, name: str) -> DataFrame | None:
        schema = TABLES[name].stored_schema.add(BUCKET, IntegerType())
        return read_parquet_if_present(self.spark, self.path(name), schema)

    def tables(self) -> Tables:
        """The tables as of now, with the frequent parents that were noted when they were loaded."""

        def load(name: str) -> DataFrame | None:
            found = self._read(name)
            return None if found is None else found.drop(BUCKET)

        return Tables(self.spark, load, lambda name: read_parquet_if_present(self.spark, f"{self.root}/_sketches/{name}"))

    # ---- writing -----------------------------------------------------------

    def staged_items(self, entity: str, items: DataFrame) -> DataFrame:
        """The items read back from Parquet, so that JSON is parsed once for all tables of the entity; until ``drop_staged``."""
        path = shared_folder(self.spark, f"items-{entity}")
        self._staged.append(path)
        items.write.parquet(path)
        return self.spark.read.schema(items.schema).parquet(path)

    def drop_staged(self) -> None:
        while self._staged:
            self._delete(self._staged.pop())

    def _buckets_of(self, name: str, first_batch: str) -> int:
        """The table's number of buckets; of a new one by the size of its first batch, a power of two."""
        known = self.buckets(name)
        if known:
            return known
        wanted = max(1, -(-folder_bytes(self.spark, first_batch) // self.bucket_bytes))
        buckets = min(MOST_BUCKETS, 1 << (wanted - 1).bit_length())
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_buckets/{name}")
        return buckets

    def _put(self, rows: DataFrame, path: str, order: list[str]) -> None:
        """Write the buckets that occur in ``rows`` in place of the stored ones; AQE splits a large bucket over tasks."""
        dealt = rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *order)
        dealt.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def upsert(self, name: str, incoming: DataFrame, replace_children: bool = False) -> int:
        """Put a batch into the table, the newer row of each key stays; the number of different rows of the batch.

        Where all rows have a key, rows that the table has already are left out, also of that number, and buckets without others are not rewritten.
        """
        path = shared_folder(self.spark, f"batch-{name}")
        try:
            return self._upsert(TABLES[name], incoming, replace_children, path)
        finally:
            self._delete(path)

    def _upsert(self, spec: TableSpec, incoming: DataFrame, replace_children: bool, path: str) -> int:
        """``upsert`` by way of a batch that is written to ``path``."""
        name = spec.name
        incoming, stored = with_arrival(conform(incoming, spec)), self._read(spec.name)
        known = None if stored is None else self.buckets(name)
        all_keyed, theirs = self._looked_over(spec, incoming, known)
        only_changes = stored is not None and not replace_children and all_keyed
        if only_changes:
            old = stored.filter(F.col(BUCKET).isin(theirs)).drop(BUCKET)
            # Where stored rows go by their parent, a batch of that parent decides about them too.
            only_changes = not spec.parent or old.filter(keyless(spec)).isEmpty()
        reduced = changed_rows(spec, old, incoming) if only_changes else reduce_batch(spec, incoming, all_keyed)
        reduced.write.parquet(path)
        batch = self.spark.read.schema(spec.stored_schema).parquet(path)
        rows = batch.count()
        if not rows:
            return 0
        buckets = self._buckets_of(name, path)
        own = bucket_of(spec, buckets)
        batch = batch.withColumn(BUCKET, own)
        small = rows <= BROADCAST_KEY_ROWS
        if stored is None:
            merged, touched = batch, None
        elif only_changes:
            touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
            old = stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            merged = put_rows(spec, old, batch.drop(BUCKET), small).withColumn(BUCKET, own)
        else:
            touched = self._touched(spec, batch, buckets, replace_children)
            old = stored if touched is None else stored.filter(F.col(BUCKET).isin(touched))
            merged = upsert_table(spec, old.drop(BUCKET), batch.drop(BUCKET), small_batch=small, replace_children=replace_children)
            merged = merged.withColumn(BUCKET, own)
        # A bucket that is left without rows is not overwritten, so its folder goes.
        gone = []
        if stored is not None and replace_children and not _whole_parent(spec):
            gone = stored.select(BUCKET).distinct().join(merged.select(BUCKET).distinct(), BUCKET, "left_anti").collect()
        self._put(merged, self.path(name), [spec.laid_out_by] if spec.laid_out_by else [])
        for row in gone:
            self._delete(f"{self.path(name)}/{BUCKET}={row[0]}")
        if spec.parent:
            now = self._read(name)
            now = now if touched is None else now.filter(F.col(BUCKET).isin(touched))
            sketches = key_sketches(now, spec.parent[0], BUCKET)
            sketches.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/_sketches/{name}")
        return rows

    def _looked_over(self, spec: TableSpec, incoming: DataFrame, buckets: int | None) -> tuple[bool, list[int]]:
        """Whether all rows have a key; of a table with buckets also those that the rows, or rows of their parents, are in."""
        nameless = F.coalesce(F.bool_or(keyless(spec)), F.lit(False)).alias("nameless")
        theirs = [] if buckets is None else [bucket_of(spec, buckets)]
        if theirs and spec.parent and not _whole_parent(spec):
            theirs.append(_hashed(spec.parent, buckets))
        row = incoming.agg(nameless, *[F.collect_set(c) for c in theirs]).first()
        return not row.nameless, sorted({b for found in row[1:] for b in found})

    def _touched(self, spec: TableSpec, batch: DataFrame, buckets: int, replace_children: bool) -> list[int] | None:
        """Buckets with rows that the batch decides about, at most ``MOST_BUCKETS`` numbers; None for all."""
        if replace_children and not _whole_parent(spec):
            return None
        found = batch.select(BUCKET)
        if spec.parent and not _whole_parent(spec):
            found = found.unionByName(batch.select(_hashed(spec.parent, buckets).alias(BUCKET)))
        return sorted(r[0] for r in found.distinct().collect())

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def append(self, name: str, rows: DataFrame) -> int:
        return self.upsert(name, with_arrival(conform(rows, name)))

