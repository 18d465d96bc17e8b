"""Keyed upserts over plain files: what MERGE would do, as joins and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.schemas import ARRIVED, TableSpec, conform, with_arrival

# Incoming key sets up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_KEY_ROWS = 1_000_000


def _key_columns(keys: Sequence[str], nullable_keys: Sequence[str]) -> list[Column]:
    plain = [F.col(key) for key in keys]
    return plain + [F.coalesce(F.col(key), F.lit("")) for key in nullable_keys]


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    nullable_keys: Sequence[str] = (),
    newest: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the largest ``newest`` columns win, NULL loses, a row hash breaks ties.

    The rank filter reaches below the shuffle (a window group limit), so at most one
    row per key and input partition is sent, however many copies a key has.
    """
    order = [F.col(name).desc_nulls_last() for name in newest]
    order.append(F.xxhash64(*[F.col(name) for name in df.columns]).desc())
    window = Window.partitionBy(*_key_columns(keys, nullable_keys)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def _named_keys(df: DataFrame, columns: Sequence[Column]) -> list[Column]:
    return [column.alias(f"_key{i}") for i, column in enumerate(columns)]


def _distinct_keys(df: DataFrame, columns: Sequence[Column], small: bool) -> DataFrame:
    keys = df.select(*_named_keys(df, columns)).distinct()
    return F.broadcast(keys) if small else keys


def _by_keys(target: DataFrame, keys: DataFrame, columns: Sequence[Column], how: str) -> DataFrame:
    condition = [column == F.col(f"_key{i}") for i, column in enumerate(columns)]
    return target.join(keys, condition, how)


def _merge_newest(target: DataFrame, batch: DataFrame, columns: Sequence[Column], newest: Sequence[str], small: bool) -> DataFrame:
    """Each target row or the batch row of its key, whichever is newer (the batch's of equals), and the batch rows of new keys.

    The target is read whole once; a second scan reads just its keys. ``batch`` has one row per key.
    """
    fresh = batch.select(*_named_keys(batch, columns), F.struct(*batch.columns).alias("_new"))
    joined = _by_keys(target, F.broadcast(fresh) if small else fresh, columns, "left")
    # Structs compare field by field, and NULL is less than anything.
    wins = F.struct(*[F.col(f"_new.{n}") for n in newest]) >= F.struct(*newest)
    take = F.col("_new").isNotNull() & wins
    merged = joined.select(*[F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])
    matched = _by_keys(target, _distinct_keys(batch, columns, small), columns, "left_semi")
    return merged.unionByName(_by_keys(batch, _distinct_keys(matched, columns, False), columns, "left_anti"))


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    nullable_keys: Sequence[str] = (),
    newest: Sequence[str] = (),
    keep_newest: bool = False,
    small_batch: bool = False,
    replace_children_of: Sequence[str] = (),
) -> DataFrame:
    """``target`` with the rows of ``incoming`` put in place by key.

    The whole row is replaced, also with NULLs. Rows with NULL in a plain key
    match nothing; in ``nullable_keys`` NULL equals NULL and ''. The batch is
    first reduced to one row per key. Keys of the target are unique.

    keep_newest: keep the target row where its ``newest`` columns are larger.
    small_batch: the caller has checked that the batch has at most
        ``BROADCAST_KEY_ROWS`` rows; it is broadcast and the target is
        not shuffled.
    replace_children_of: also drop target rows whose parent key occurs in the
        batch, so that removed children disappear.
    """
    columns = _key_columns(keys, nullable_keys)
    batch = latest_per_key(incoming, keys, nullable_keys, newest)
    if keep_newest and not replace_children_of:
        return _merge_newest(target, batch, columns, newest, small_batch)
    kept = _by_keys(target, _distinct_keys(batch, columns, small_batch), columns, "left_anti")
    if replace_children_of:
        parents = [F.col(name) for name in replace_children_of]
        kept = _by_keys(kept, _distinct_keys(batch, parents, small_batch), parents, "left_anti")
    return kept.unionByName(batch)


def keyless(spec: TableSpec) -> Column:
    """Rows with NULL in a plain key, which no key can match."""
    return reduce(Column.__or__, [F.col(k).isNull() for k in spec.keys])


def _newest_keyless(spec: TableSpec, rows: DataFrame, known: DataFrame) -> DataFrame:
    """Different keyless rows, each once; of a child table only those of the last arrival of their parent in ``known``."""
    if spec.parent:
        last = known.groupBy(*[F.col(p).alias(f"_of{i}") for i, p in enumerate(spec.parent)]).agg(F.max(ARRIVED).alias("_last"))
        on = [F.col(p).eqNullSafe(F.col(f"_of{i}")) for i, p in enumerate(spec.parent)]
        rows = rows.join(last, [*on, F.col(ARRIVED).eqNullSafe(F.col("_last"))], "left_semi")
    declared = spec.schema.fieldNames()
    return rows.groupBy(*declared).agg(F.max(ARRIVED).alias(ARRIVED)).select(*declared, ARRIVED)


def reduce_batch(spec: TableSpec, incoming: DataFrame, all_keyed: bool = False) -> DataFrame:
    """The newest row of each key, and the rows without a key that ``_newest_keyless`` leaves.

    all_keyed: the caller has checked that no row is without a key, so they are not looked for.
    """
    rows = with_arrival(conform(incoming, spec))
    if all_keyed:
        return latest_per_key(rows, spec.keys, spec.nullable_keys, spec.newest)
    keyed = latest_per_key(rows.filter(~keyless(spec)), spec.keys, spec.nullable_keys, spec.newest)
    return keyed.unionByName(_newest_keyless(spec, rows.filter(keyless(spec)), rows))


def changed_rows(spec: TableSpec, target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest incoming row of each key, where the target has an older one, one as new that says something else, or none.

    All rows have a key. The incoming rows are shuffled once, by key; of the target only keys, what tells its age, and a hash of each row are.
    """
    columns = _key_columns(spec.keys, spec.nullable_keys)
    said = F.xxhash64(*spec.schema.fieldNames())
    rows = with_arrival(conform(incoming, spec))
    named = [f"_key{i}" for i in range(len(columns))]
    newest = latest_per_key(rows.select("*", *_named_keys(rows, columns)), named, newest=spec.newest)
    target = with_arrival(conform(target, spec))
    had = target.select(*[c.alias(f"_had{i}") for i, c in enumerate(columns)], F.struct(*spec.newest).alias("_had"), said.alias("_said"))
    joined = newest.join(had, [F.col(n) == F.col(f"_had{i}") for i, n in enumerate(named)], "left")
    age = F.struct(*spec.newest)
    other = F.col("_had").isNull() | (age > F.col("_had")) | ((age >= F.col("_had")) & (said != F.col("_said")))
    return joined.filter(other).select(*rows.columns)


def put_rows(spec: TableSpec, target: DataFrame, rows: DataFrame, small_batch: bool = False) -> DataFrame:
    """``target`` with ``rows`` from ``changed_rows`` in place of those of the same keys."""
    columns = _key_columns(spec.keys, spec.nullable_keys)
    target = with_arrival(conform(target, spec))
    keys = rows.select(*_named_keys(rows, columns))
    return _by_keys(target, F.broadcast(keys) if small_batch else keys, columns, "left_anti").unionByName(rows)


def upsert_table(
    spec: TableSpec,
    target: DataFrame,
    incoming: DataFrame,
    small_batch: bool = False,
    replace_children: bool = False,
) -> DataFrame:
    """The stored table with a batch put in: the newer row of each key stays, by the table's version, then by arrival.

    Rows without a key cannot be told apart by one, so they go by their parent: the different ones of its last arrival
    stay. Sending the same records again thus changes nothing.
    """
    target, batch = with_arrival(conform(target, spec)), reduce_batch(spec, incoming)
    nameless = keyless(spec)
    merged = upsert(
        target.filter(~nameless),
        batch.filter(~nameless),
        spec.keys,
        spec.nullable_keys,
        newest=spec.newest,
        keep_newest=True,
        small_batch=small_batch,
        replace_children_of=spec.parent if replace_children else (),
    )
    old, new = target.filter(nameless), batch.filter(nameless)
    if not spec.parent:
        return merged.unionByName(_newest_keyless(spec, old.unionByName(new), batch))
    parents = batch.select(*[F.col(p).alias(f"_of{i}") for i, p in enumerate(spec.parent)]).distinct()
    parents = F.broadcast(parents) if small_batch else parents
    on = [F.col(p).eqNullSafe(F.col(f"_of{i}")) for i, p in enumerate(spec.parent)]
    contested = old.join(parents, on, "left_semi").unionByName(new)
    settled = _newest_keyless(spec, contested, contested.unionByName(batch))
    return merged.unionByName(old.join(parents, on, "left_anti")).unionByName(settled)
