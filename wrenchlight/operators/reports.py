"""Small report operators: newest rows, row counts, integer shares, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_rows(df: DataFrame, by: str, n: int, *tie_breakers: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``, NULLs last. Each task keeps n rows, no full sort."""
    order = [F.col(by).desc_nulls_last(), *[F.col(name) for name in tie_breakers]]
    return df.orderBy(*order).limit(n)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each frame; empty tables count 0."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def integer_shares(df: DataFrame, share: str, out: str, *tie_breakers) -> DataFrame:
    """Adds ``out``: whole percentages that add up to 100 (largest remainder).

    Shares are cut towards zero; what is missing to 100 is dealt out one by one,
    largest fraction first, round after round, and taken away if there is too
    much. For aggregated frames of a few rows: the window has no partition key.
    """
    whole = F.col(share).cast("bigint")
    everything = Window.partitionBy()
    dealt = Window.orderBy((F.col(share) - whole).desc(), *tie_breakers)
    missing = F.lit(100) - F.sum(whole).over(everything)
    rows = F.count(F.lit(1)).over(everything)
    extra = F.floor(F.abs(F.col("_missing")) / F.col("_rows")) + F.when(
        F.col("_place") <= F.abs(F.col("_missing")) % F.col("_rows"), 1
    ).otherwise(0)
    return (
        df.withColumns({"_missing": missing, "_rows": rows, "_place": F.row_number().over(dealt)})
        .withColumn(out, (whole + F.signum("_missing").cast("bigint") * extra).cast("bigint"))
        .drop("_missing", "_rows", "_place")
    )


def lookup_for_few(few: DataFrame, big: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Left join of a frame of at most some hundred rows with a large one, without shuffling it.

    Spark cannot broadcast the kept side of an outer join. So each of the few
    rows is sent out twice, under its key and under a marker; the large side gets
    one more row with the marker; the inner join then finds at least the marker
    row, and the real match, if any, is preferred. Rows of ``few`` must be unique,
    and ``key`` unique in ``big``.
    """
    marker = big.sparkSession.range(0, 1, 1, numPartitions=1).select(
        F.lit(None).cast("string").alias("_key"),
        *[F.lit(None).cast(big.schema[name].dataType).alias(name) for name in values],
        F.lit(True).alias("_marker"),
    )
    real = big.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *values, F.lit(False).alias("_marker"))
    sides = real.unionByName(marker)
    wanted = few.withColumn("_wanted", F.explode(F.array(F.col(key), F.lit(None).cast("string"))))
    found = sides.join(F.broadcast(wanted), F.col("_key").eqNullSafe(F.col("_wanted")))
    best = [F.max_by(name, ~F.col("_marker")).alias(name) for name in values]
    return found.groupBy(*few.columns).agg(*best)
