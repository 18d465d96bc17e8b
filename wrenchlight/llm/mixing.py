"""Mixing sources to target weights over a time-varying curriculum.

Targets. The weights share out all sizes; a source stops at ``repeat`` times its size and its excess is shared out by weight
among the others until none is above (the level L with sum(min(cap, L * weight)) = total).

Documents. Each source is read in the order of a digest of the document, again from the start after each pass; rows with equal digests (equal in doc_id and text)
follow one another. A row's place is the number of words before it; the copy of pass p is taken while its middle, p times the source's size
plus place plus half its size, lies below the target. So a source misses its target by at most half a document, however many rows are equal, and
none is taken more than ``repeat`` times.

Curriculum. A source's weight runs in a straight line from ``1 + ramp`` times its target share at the start of training to
``1 - ramp`` times at the end. The integral is its cumulative demand; a copy's position in training, between 0 and 1, is
where the demand reaches the copy's place: t with t + ramp * (t - t * t) = place / target. The schedule is range-sorted by position.

Running sums of a source of any size: digests fall into 65536 buckets of a source, which are summed first; only the sums
of the buckets are accumulated over the source. Within a bucket the rows of one digest and one task of the scan are one chunk, with a count; chunks are accumulated, and a row
finds its place from its number within its chunk. A digest that a third of all rows share is thus as many chunks as tasks read it.

Defined results: sizes count words ``[^\\x20\\x09-\\x0D]+``, 0 for NULL and empty texts. NULL is a source of its own, last in order. The order
of sources is by code point; weights repeat along it. Which of several equal rows is taken is not defined, how many are is. An empty table or one without words takes nothing.
Texts of any length are counted whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.llm.common import stored

WEIGHTS = (5, 2, 1)
RAMPS = (0.5, 0.0, -0.5)
REPEAT = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with ``place``, their number in the order of code points, NULL last: sorted by range, counted per partition."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "sources")
    sizes = ordered.groupBy("part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    return ordered.join(before, "part").withColumn("place", F.coalesce("before", F.lit(0)) + F.col("at") - F.shiftleft(F.col("part"), 33)).drop("at", "part", "count", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target, ramp; sizes: source, source_size."""
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1
    rows = _numbered(sizes).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    rows = rows.withColumn("ramp", F.element_at(F.array(*map(F.lit, ramps)), F.pmod(F.col("place"), F.lit(len(ramps))).cast("int") + 1))
    rows = stored(rows.withColumn("cap", repeat * F.col("source_size")), "weighted-sources")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full = F.lit(False)
    level, count = 0.0, -1
    while True:  # each round at least one more source is full, or the level stands; only sums reach the driver
        caps, open_weight, n = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == count or not open_weight:
            break
        count, level = n, (total - (caps or 0)) / open_weight
        full = F.col("cap") < F.lit(level) * F.col("weight")
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"), "ramp")


def _position(share: Column, ramp: Column) -> Column:
    """Where the integral of 1 + ramp - 2 * ramp * t reaches ``share``."""
    root = F.sqrt(F.greatest((1 + ramp) * (1 + ramp) - 4 * ramp * share, F.lit(0.0)))
    return F.when(ramp == 0, share).otherwise((1 + ramp - root) / (2 * F.when(ramp == 0, F.lit(1.0)).otherwise(ramp)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, repeat: int = REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, positions (of each copy in training, ascending)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), digest.alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows.withColumn("part", F.shiftright("at", 33)), "sizes")
    chunks = stored(rows.groupBy("source", "digest", "size", "part").agg(F.count("*").alias("n")).withColumn("bucket", F.substring("digest", 1, 4)), "chunks")
    words = F.col("n") * F.col("size")
    buckets = stored(chunks.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size")), "buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, repeat)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    goal = goal.withColumnRenamed("source", "goal_source")
    known = stored(placed.join(goal, placed["source"].eqNullSafe(goal["goal_source"])).select(F.col("source").alias("known_source"), F.col("bucket").alias("known_bucket"), "bucket_start", "source_size", "target", "ramp"), "places")
    within = Window.partitionBy("source", "bucket").orderBy("digest", "part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_start", F.coalesce(F.sum(words).over(within), F.lit(0)))
    chunks = chunks.join(known, chunks["source"].eqNullSafe(F.col("known_source")) & (chunks["bucket"] == F.col("known_bucket")))
    chunks = chunks.select(F.col("digest").alias("chunk_digest"), F.col("part").alias("chunk_part"), "known_source", (F.col("bucket_start") + F.col("chunk_start")).alias("start"), "source_size", "target", "ramp")
    number = F.row_number().over(Window.partitionBy("source", "digest", "part").orderBy("at"))
    rows = rows.withColumn("number", number - 1)
    rows = rows.join(chunks, (rows["digest"] == F.col("chunk_digest")) & (rows["part"] == F.col("chunk_part")) & rows["source"].eqNullSafe(F.col("known_source")))
    rows = rows.withColumn("place", F.col("start") + F.col("number") * F.col("size"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda p: F.col("place") + p * F.col("source_size"))
    taken = F.filter(starts, lambda s: (F.col("size") > 0) & (s + F.col("size") / 2 < F.col("target")))
    share = lambda s: _position(F.least((s + F.col("size") / 2) / F.col("target"), F.lit(1.0)), F.col("ramp"))
    rows = rows.withColumn("starts", taken).withColumn("copies", F.size("starts")).withColumn("positions", F.transform("starts", share))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions")


def schedule(mix: DataFrame, *more: str) -> DataFrame:
    """One row for each copy in training order: position, doc_id, source, size, range-sorted by position; ``more`` columns follow and break ties."""
    return mix.select(F.explode("positions").alias("position"), "doc_id", "source", "size", *more).orderBy("position", "doc_id", *more)


def _stored_mix(docs: DataFrame, *how) -> DataFrame:
    """mixed(docs), written, with a number of each row."""
    return stored(mixed(docs, *how).withColumn("row", F.monotonically_increasing_id()), "mix")


def taken_by_schedule(docs: DataFrame, *how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, first and last position of each row, summed from the written schedule."""
    rows = _stored_mix(docs, *how)
    copies = stored(schedule(rows, "row"), "schedule")
    found = copies.groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").cast("int").alias("copies"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    found = rows.drop("taken", "copies", "positions").join(found, "row", "left").drop("row")
    return found.withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "copies": F.coalesce("copies", F.lit(0))})


def training_order(docs: DataFrame, *how) -> DataFrame:
    """The sorted schedule with all columns of the mix: one row for each copy, by position; documents that are not taken come last, with a NULL position."""
    rows = _stored_mix(docs, *how).withColumn("position", F.explode_outer("positions"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id", "row").select("position", "doc_id", "source", "size", "source_size", "target", "taken", "copies")
