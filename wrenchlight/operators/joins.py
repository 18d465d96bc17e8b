"""Equi-join whose many-rows side may have very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of the rows is split over many tasks.
HOT_SHARE = 0.001
# No more than 1 / HOT_SHARE keys can exceed the share, so this bounds what is broadcast.
MAX_HOT_KEYS = 1000
SKETCH_ITEMS = 10_000


def key_sketches(df: DataFrame, key: str, by: str) -> DataFrame:
    """(by, sketch, n): a mergeable frequency sketch of the keys for each value of ``by``, to be stored."""
    sketch = F.expr(f"approx_top_k_accumulate({key}, {SKETCH_ITEMS})")
    return df.filter(F.col(key).isNotNull()).groupBy(by).agg(sketch.alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_hot_keys(sketches: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """(hot_key): the keys that hold more than ``share`` of the rows behind all sketches, at most 1000."""
    top = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {SKETCH_ITEMS}), {MAX_HOT_KEYS})")
    # Grouped by a constant, as combining no sketches at all is an error.
    merged = sketches.groupBy(F.lit("all")).agg(top.alias("top"), F.sum("n").alias("n"))
    listed = merged.select("n", F.explode("top").alias("entry"))
    return listed.filter(F.col("entry.count") > F.col("n") * share).select(
        F.col("entry.item").alias("hot_key")
    )


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """(hot_key): the keys that hold more than ``share`` of the rows, at most 1000.

    Frequency sketches are merged per group of partitions first, so that the last
    step gets a few hundred sketches, however many tasks the scan has.
    """
    grouped = df.select(key, (F.spark_partition_id() % 256).alias("part"))
    return merged_hot_keys(key_sketches(grouped, key, "part"), share)


def spread_join(
    many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """``many.join(one, key, how)`` for inner and left joins, whatever the frequency of keys in ``many``.

    Rows of hot keys get a salt from a hash of the whole row, and the matching rows
    of ``one`` are repeated once per salt; everything else is joined as it is. The
    result does not depend on which keys are found hot. NULL keys match nothing
    and are spread as well.

    hot: the frequent keys as (hot_key), at most 1000, where they are known; else ``many`` is computed a second time to find them.
    """
    # More salts than partitions, so that they even out over the partitions they hash to.
    salts = 4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(many, key) if hot is None else hot)
    is_hot = F.col("hot_key").isNotNull()
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(salts)).cast("int")
    salted = (
        many.join(hot, F.col(key) == F.col("hot_key"), "left")
        .withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(0))
        .drop("hot_key")
    )
    every_salt = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = (
        one.join(hot, F.col(key) == F.col("hot_key"), "left")
        .withColumn("_salt", F.explode(every_salt))
        .drop("hot_key")
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
