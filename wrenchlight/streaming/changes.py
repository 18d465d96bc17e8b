"""What is new in a stream of records: a state holds the newest version of each key, so records sent again are dropped before they are written.

The one place of the library with Python on rows: Spark's own stateful operators keep the first row of a key, not the newest one. Keys are dealt into
groups by hash, as a call for each key costs milliseconds; a group's state lists a few words for each of its keys. A group's rows
come in Arrow batches and only the newest of each key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wrenchlight.schemas import ARRIVED
from wrenchlight.sources.landing import item_schema

_RECORD = "key string, version string, arrived string, record string"
_STATE = "keys array<string>, versions array<string>, arrivals array<string>, digests array<string>"

# Groups of keys: with ten million keys some thousand in each. A stream keeps the number it began with.
KEY_GROUPS = 1 << 12


def record_key(entity: str) -> Column:
    """What names a record: ``uuid``, where the entity has one, else ``id``."""
    names = [n for n in ("uuid", "id") if n in item_schema(entity).fieldNames()]
    return F.coalesce(*[F.col(n) for n in names])


def as_records(items: DataFrame, entity: str) -> DataFrame:
    """(key, version, arrived, record): items as JSON beside what tells their order."""
    names = item_schema(entity).fieldNames()
    version = F.coalesce("updated_at", F.lit("")) if "updated_at" in names else F.lit("")
    return items.select(record_key(entity).alias("key"), version.alias("version"), F.col(ARRIVED).alias("arrived"), F.to_json(F.struct(*names)).alias("record"))


def as_items(records: DataFrame, entity: str) -> DataFrame:
    """The items that the records stand for, with their arrival."""
    parsed = records.select(F.from_json("record", item_schema(entity)).alias("item"), F.col("arrived").alias(ARRIVED))
    return parsed.select("item.*", ARRIVED)


def _newest(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {key: rest for key, *rest in zip(*state.get)} if state.exists else {}
    found: dict[str, tuple[str, str, str, str]] = {}
    for frame in frames:
        for key, version, arrived, digest, record in zip(*[frame[c].tolist() for c in ("key", "version", "arrived", "digest", "record")]):
            row = (version or "", arrived or "", digest, record)
            if key not in found or row > found[key]:
                found[key] = row
    changed = []
    for key, (version, arrived, digest, record) in found.items():
        before = known.get(key)
        if before and (version, arrived) <= (before[0], before[1]):
            continue
        known[key] = (version, arrived, digest)
        if before is None or digest != before[2]:
            changed.append((key, version, arrived, record))
    state.update((list(known), *[[rest[i] for rest in known.values()] for i in range(3)]))
    if changed:
        yield pd.DataFrame(changed, columns=["key", "version", "arrived", "record"])


def changes(records: DataFrame) -> DataFrame:
    """Of a stream from ``as_records`` the records that are newer than what their key had, and say something else.

    Which of two is newer: the later version, then the later arrival. Records without a key have no state and pass.
    """
    group = F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)).cast("int")
    keyed = records.filter(F.col("key").isNotNull()).withColumns({"digest": F.sha2("record", 256), "key_group": group})
    newest = keyed.groupBy("key_group").applyInPandasWithState(_newest, _RECORD, _STATE, "append", GroupStateTimeout.NoTimeout)
    return newest.unionByName(records.filter(F.col("key").isNull()))
