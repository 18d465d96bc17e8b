"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of lower-case words and typed placeholders: a number (several parts joined by one of .,:/- are
one), a unit (a known word right behind a number), a name (capitalised words, by Unicode; neighbours in a sentence are
one). What a capital says differs: at the start of a sentence it may be a name or not, and some languages capitalise every noun. So each text is read in three ways, in which names are capitalised words within
sentences, all capitalised words, or none, and windows meet only windows of the same reading. Windows of ``window`` words are hashed. Windows of documents meet those of benchmark items in a hash join; matches of
a document and an item at the same offset are counted, and also those of neighbouring offsets together (up to ``near`` words apart), as words may have been put in or left out. The slots must be consistent: within a match each value of
the item stands for one value of the document and the other way round. So a question with other numbers
or names is found, and a text that merely has the same frame but mixes its values is not.

A document holds an item if at least ``share`` of the item's windows match, or so many that ``run`` words match.

Before the shuffle, document windows are held against a Bloom filter of the item windows' hashes (two bits each), of fixed size (2**22 bits) however
large the benchmark; the exact join follows.

Defined results: windows with fewer than ``literals`` plain words do not count, so all-number tables match nothing. Items with fewer words than a
window hold no windows and are never found. NULL and empty texts hold none. Repeated documents are each found; repeated
items are found under each item_id. Texts of any length are read whole. NULL ids are kept as ids. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.llm.arrays import Ranges, buffer_of, mixed, word_hashes
from wrenchlight.llm.common import KEY, keyed, map_arrow, may_contain, same_key, stored, type_of

WINDOW, SHARE, RUN, LITERALS, NEAR = 5, 0.8, 25, 3, 5
SLOTS = 1 << 22
READINGS = ("within sentences", "all", "none")
# Unit words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kmh"
).split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Code points of two bytes in UTF-8: which are capitals, and their small letters.
_CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])
_SMALL = np.array([ord(x) if len(x := chr(c).lower()) == 1 and 0x80 <= ord(x) < 0x800 else c for c in range(0x800)])
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_JOINT = np.zeros(256, bool)
_JOINT[list(b".,:/-")] = True
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3))
_TOKEN_BASE = 0xC2B2AE3D27D4EB4F


def _unit_hashes() -> np.ndarray:
    data, offsets = buffer_of(pa.array(UNITS))
    return np.sort(word_hashes(data, offsets[:-1], offsets[1:]))


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in small letters, and where a capital begins."""
    lower, capital = _LOWER[data], (data >= 65) & (data <= 90)
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF)) if len(data) > 1 else np.zeros(0, np.int64)
    points = (data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
    capital[lead] = _CAPITAL[points]
    lower[lead], lower[lead + 1] = 0xC0 | (_SMALL[points] >> 6), 0x80 | (_SMALL[points] & 0x3F)
    return lower, capital


def templates(column: pa.Array, readings: tuple[str, ...] = READINGS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each reading, of all texts in turn: hash of each template word, hash of its value (0 for plain words), number of its text."""
    data, offsets = buffer_of(column)
    inside = _INSIDE[data]
    quote = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    for i in range(3):  # general punctuation: quotes, dashes, ellipsis
        inside[quote + i] = False
    padded = np.concatenate([[False], inside, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(padded[1:] & (~padded[:-1] | edge))
    ends = np.flatnonzero(padded[:-1] & (~padded[1:] | edge))
    owner = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), owner)] * len(readings)
    lower, capitals = _lowered(data)
    hashes = word_hashes(lower, starts, ends)
    count = lambda table: np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    digits, stops = count(_DIGIT), count(_STOP)
    first = np.ones(len(starts), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.roll(ends, 1)
    number = digits[ends] > digits[starts]
    parts = number & np.roll(number, 1) & ~first & (starts == before + 1) & _JOINT[data[np.maximum(starts - 1, 0)]]
    units = _unit_hashes()
    unit = ~number & np.roll(number, 1) & ~first & (units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes)
    capital = capitals[starts] & ~number
    goes_on = ~first & (stops[starts] == stops[np.where(first, starts, before)])
    out = []
    for reading in readings:
        name = capital & goes_on if reading == "within sentences" else capital & ~unit if reading == "all" else np.zeros(len(starts), bool)
        joined = parts | (name & goes_on & np.roll(name & goes_on, 1))  # the first word of a sentence stands alone
        keep = np.flatnonzero(~joined)
        last = np.append(keep[1:] - 1, len(starts) - 1)  # the last part of a joined slot
        kind = np.select([number[keep], unit[keep], name[keep]], [NUMBER, UNIT, NAME], np.uint64(0))
        values = np.where(kind > 0, word_hashes(lower, starts[keep], ends[last]) | np.uint64(1), np.uint64(0))
        out.append((np.where(kind > 0, mixed(kind), hashes[keep]), values, owner[keep]))
    return out


def windows(texts: DataFrame, keys: tuple[str, ...], wanted: np.ndarray | None = None, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """keys, reading, pos, hash, values (of the slots, 0 for plain words) of each window; ``wanted``: packed bits of a filter that a window must pass."""

    def found_in(piece: pa.RecordBatch, reading: int, words: np.ndarray, values: np.ndarray, owner: np.ndarray) -> list[pa.Array] | None:
        at = np.arange(max(0, len(words) - window + 1))
        at = at[owner[at] == owner[at + window - 1]]
        plain = np.append(0, np.cumsum(values == 0))
        at = at[plain[at + window] - plain[at] >= literals]
        if not len(at):
            return None
        found = mixed(Ranges(words, _TOKEN_BASE).hashes(at, at + window) + np.uint64(reading))
        if wanted is not None:
            for which in (0, 1):
                slot = _slots(found)[which]
                hit = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at, found = at[hit], found[hit]
        first = np.searchsorted(owner, owner[at])
        slots = pa.FixedSizeListArray.from_arrays(pa.array(values[at[:, None] + np.arange(window)].ravel().view(np.int64)), window).cast(pa.list_(pa.int64()))
        columns = [pa.array(np.full(len(at), reading, np.int32)), pa.array((at - first).astype(np.int32)), pa.array(found.view(np.int64)), slots]
        return [*(piece.column(k).take(pa.array(owner[at])) for k in keys), *columns]

    def make(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        made = [found_in(piece, n, *template) for n, template in enumerate(templates(piece.column("text")))]
        made = [m for m in made if m is not None and len(m[-1])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([m[i] for m in made]) for i in range(len(keys) + 4)], [*keys, "reading", "pos", "hash", "values"]) if made else None

    kinds = ", ".join(f"{k} {type_of(texts, k)}" for k in keys)
    return map_arrow(texts, make, f"{kinds}, reading int, pos int, hash long, values array<long>")


def _slots(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    return (found & np.uint64(SLOTS - 1)).astype(np.int64), ((found >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _filter(items: DataFrame) -> np.ndarray:
    """The filter's bits: at most SLOTS numbers reach the driver, as Arrow."""
    both = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(SLOTS - 1))))
    used = items.select(both.alias("bit")).distinct().toArrow().column("bit").to_numpy()
    bits = np.zeros(SLOTS, np.uint8)
    bits[used] = 1
    return np.packbits(bits, bitorder="little")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN, literals: int = LITERALS, near: int = NEAR) -> DataFrame:
    """doc_id, text_key, item_id, n_windows, item_windows, n_slots, n_changed (slots with another value) of each document and item it holds; docs: from keyed()."""
    texts = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = stored(windows(texts, ("item_id",), None, window, literals), "benchmark-windows")
    sizes = items.groupBy("item_id", "reading").agg(F.count_distinct("pos").alias("item_windows"))
    found = windows(docs, KEY, _filter(items), window, literals).drop("reading")
    known = items.select("hash", "item_id", "reading", F.col("pos").alias("item_pos"), F.col("values").alias("item_values"))
    matched = found.join(known, "hash").withColumn("shift", F.col("pos") - F.col("item_pos"))
    pairs = F.filter(F.arrays_zip("item_values", "values"), lambda x: x["item_values"] != 0)
    matched = matched.select(*KEY, "item_id", "reading", "shift", "item_pos", pairs.alias("pairs"))
    groups = (*KEY, "item_id", "reading")
    alone = matched.groupBy(*groups, "shift").agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    alone = stored(alone, "offsets")
    # Offsets that follow one another closely, together.
    order = Window.partitionBy(*groups).orderBy("shift")
    begins = F.when(F.col("shift") - F.lag("shift").over(order) <= near, 0).otherwise(1)
    chained = alone.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order)).groupBy(*groups, "chain")
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    together = chained.agg(F.min("shift").alias("shift"), F.count("*").alias("offsets"), merged("places").alias("places"), merged("pairs").alias("pairs")).filter("offsets > 1")
    counted = alone.unionByName(together.drop("chain", "offsets")).withColumn("n_windows", F.size("places"))
    one = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda x: x[side]))) == F.size("pairs")
    changed = F.size(F.filter("pairs", lambda x: x["item_values"] != x["values"]))
    counted = counted.filter(one("item_values") & one("values")).select(*groups, "shift", "n_windows", F.size("pairs").alias("n_slots"), changed.alias("n_changed"))
    sizes = stored(sizes.withColumnsRenamed({"item_id": "known_item", "reading": "known_reading"}), "item-sizes")
    held = counted.join(sizes, F.col("item_id").eqNullSafe(F.col("known_item")) & (F.col("reading") == F.col("known_reading")))
    held = held.filter((F.col("n_windows") >= share * F.col("item_windows")) | (F.col("n_windows") + window - 1 >= run))
    best = F.max(F.struct((F.col("n_windows") / F.col("item_windows")).alias("share"), (-F.col("reading")).alias("plainest"), (-F.col("shift")).alias("early"), "n_windows", "item_windows", "n_slots", "n_changed")).alias("best")
    return held.groupBy(*KEY, "item_id").agg(best).select(*KEY, "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), "best.item_windows", "best.n_slots", "best.n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, find: Callable[..., DataFrame] = leaks) -> DataFrame:
    """The rows of docs that hold no item, as they are."""
    found = stored(find(keyed(docs), benchmark).select(*KEY).distinct(), "leaking-documents")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    some, rest = may_contain(rows, found, "text_key")
    return some.join(found, same_key(some, found), "left_anti").select("row").union(rest.select("row")).select("row.*")
