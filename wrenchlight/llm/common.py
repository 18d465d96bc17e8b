"""What several operators share: stored intermediate tables, document keys, Arrow pieces, connected components.

A document is known by ``doc_id`` together with a hash of its text, so a NULL or repeated
``doc_id`` never mixes different texts. Rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlight.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
KEY = ("doc_id", "text_key")
PIECE_BYTES = 2 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends here, and lost executors do no harm."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_key, text and some more columns; NULL texts become empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"), *more)


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_key"] == b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with ``place``, their number from 0 in this order: sorted by range, then counted per partition, so no task sees all rows."""
    ordered = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = ordered.groupBy(part).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = ordered.withColumn("part", part).join(F.broadcast(starts), F.col("part") == F.col("of_part"))
    return placed.withColumn("place", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "of_part", "before")


def slot(column: Column | str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("slot")), F.lit(slots))


def may_contain(left: DataFrame, keys: DataFrame, column: str, slots: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` whose key may occur in ``keys``, and those whose key surely does not.

    A runtime filter ahead of a shuffle: the broadcast side is the set of hash slots in use, at most
    ``slots`` numbers whatever the data. An exact join of the first part has to follow.
    """
    used = F.broadcast(keys.select(slot(column, slots).alias("used_slot")).distinct())
    on = slot(left[column], slots) == used["used_slot"]
    return left.join(used, on, "left_semi"), left.join(used, on, "left_anti")


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece have about ``limit`` bytes; one longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column, limit):
            made = make(piece)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def texts(piece: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; bytes.split() then cuts at exactly space and \\x09-\\x0D."""
    return [t or b"" for t in piece.column(column).cast(pa.binary()).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its connected component, for edges(a, b) of longs.

    Alternating large-star and small-star steps until nothing changes, a logarithmic number of rounds in practice.
    A node's smallest neighbour comes from a partial aggregation, is written, and is joined back: a plain shuffle on either
    side, which AQE splits at nodes of high degree. Nodes without edges do not occur.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        linked = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(linked.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(tops.select("node", F.col("node").alias("label")))
