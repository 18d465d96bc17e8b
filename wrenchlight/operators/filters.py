"""Cutting a large table to the keys of a small one ahead of a shuffle, by a Bloom filter kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of 64 bits in the filter; each becomes one row of the broadcast at most, some 20 MB in all, however many keys there are.
WORDS = 1 << 19
BITS_PER_KEY = 3
# Below this size of its files a table is joined as it is: the filter costs a second scan of the keys.
FILTER_FROM_BYTES = 1 << 30


def _place(key: Column) -> tuple[Column, Column]:
    """The word of a key, and the bits of its word that stand for it."""
    hashed = F.xxhash64(key, F.lit("key filter"))
    word = F.pmod(hashed, F.lit(WORDS)).cast("int")
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        bit = F.shiftrightunsigned(hashed, 63 - 6 * (i + 1)).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return word, mask


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): a blocked Bloom filter of the keys, made with partial aggregation."""
    word, mask = _place(F.col(key))
    return keys.filter(F.col(key).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))


def may_match(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ``keys``: all that are, and some others. NULL keys go. An exact join has to follow."""
    made = F.broadcast(key_filter(keys, key))
    word, mask = _place(F.col(key))
    return rows.join(made, (word == made["word"]) & (made["bits"].bitwiseAND(mask) == mask), "left_semi")


def scanned_bytes(df: DataFrame) -> int:
    """Size of what the scans below ``df`` read at most, as the file listing knows it; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def near(rows: DataFrame, keys: DataFrame, key: str, from_bytes: int = FILTER_FROM_BYTES) -> DataFrame:
    """``may_match`` where the scan of ``rows`` is large, else ``rows``."""
    return may_match(rows, keys, key) if scanned_bytes(rows) >= from_bytes else rows
