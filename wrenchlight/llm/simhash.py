"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half of the allowed distance. Two fingerprints within the distance share
a variant, and two that share one are within the distance, so a shuffle on variants finds all links. A
variant has at most as many different fingerprints as a ball has points (65 for one bit), so no group can grow with
the data; copies are folded into one fingerprint first.

Defined results: NULL and empty texts have no words and the fingerprint zero, which links like any other.
Fewer words than a shingle make one shingle of all words. Repeated rows and equal texts share a
fingerprint, hence a component. NULL doc_ids do not count for ``component_id``; a component without any other has NULL.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.llm.common import KEY, components, keyed, map_arrow, same_key, stored, texts, type_of

BITS = 64
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of every shingle, as a signed 64-bit number. ASCII letters are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    total, ones = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    hashes = (xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams)
    for start in range(0, total, AT_ONCE):
        n = min(AT_ONCE, total - start)
        part = np.fromiter(hashes, np.uint64, n)
        ones += np.unpackbits(part.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_key, fp of each document."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([fingerprint(t, shingle, seed) for t in texts(piece)], pa.int64())
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), found], [*KEY, "fp"])

    return map_arrow(keyed(docs), make, f"doc_id {type_of(docs, 'doc_id')}, text_key long, fp long")


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints at most ``max_bits`` (an even number) apart.

    Within a variant each fingerprint is linked to the next larger one: all of them are within
    the distance of each other, so this keeps every component without writing all pairs.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even: both sides flip half of it")
    flips = [sum(1 << i for i in c) for n in range(max_bits // 2 + 1) for c in combinations(range(BITS), n)]
    masks = [F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in flips]
    # Few bytes that become many rows: dealt out by number, as AQE would put them into one or two tasks.
    spark = prints.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    balls = prints.select("fp").distinct().repartition(tasks, "fp").select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(m) for m in masks))).alias("variant"))
    by_variant = Window.partitionBy("variant").orderBy("fp")
    pairs = balls.select(F.col("fp").alias("a"), F.lead("fp").over(by_variant).alias("b")).filter("b is not null").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def labelled(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """prints with ``label``, the fingerprint that stands for the component."""
    groups = components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    return prints.join(groups, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for each document."""
    found = stored(labelled(stored(fingerprints(docs, shingle), "fingerprints"), max_bits), "components")
    first = stored(found.groupBy("label").agg(F.min("doc_id").alias("component_id")), "first-documents")
    return found.join(first, "label").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest doc_id stays (NULL last), all columns as they are."""
    found = stored(labelled(stored(fingerprints(docs, shingle), "fingerprints"), max_bits), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))
    kept = found.groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_key").alias("text_key"))
    rows = docs.select(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), "doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.join(kept, same_key(rows, kept)).groupBy(rows["doc_id"], rows["text_key"]).agg(F.min("row").alias("row"))
    return one.select("row.*")
