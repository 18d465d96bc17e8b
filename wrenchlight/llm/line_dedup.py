"""Line dedup by a suffix order over line-ID sequences, built by distributed prefix doubling.

Lines with a word are numbered within their document; hashes of their text are the line IDs. The suffixes of all
documents are ordered by their first 1, 2, 4, … lines: two ranks ``k`` lines apart give the rank by 2k lines. Each step counts
the pairs of ranks by partial aggregation, sorts the different pairs that occur more than once by range, numbers them
in that order, and joins the numbers back. A suffix whose prefix is unique leaves, so the
tables shrink from step to step, and equal lines never have to meet in one task.

Equal ranks by m lines are the intervals of the suffix array with a longest common prefix of at least m. The first
suffix of an interval (by document, then line) is the first copy of that run of m lines, all others are
later copies. A run counts with ``min_words`` words or more. A line of a run that counts lies in a least such run, which
ends as soon as the words suffice: it has at most ``min_words`` lines and at most one line that counts by itself. So
deeper intervals, which lie within these, and prefixes with two such lines need no steps. A line is
deleted if it lies in a later copy of a run that counts; maximal repeated runs are the stretches of deleted lines.

Defined results: lines are cut at \\n; those without ``[^\\x20\\x09-\\x0D]`` are never deleted and do not interrupt runs. The
first copy always stays. Documents are ordered by doc_id (NULL last), then by a hash of the text. Rows equal in doc_id and
text are one document: no copies of each other, and treated alike. NULL texts stay NULL. A document may become empty and
stays. Other columns are carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.common import KEY, keyed, map_arrow, may_contain, same_key, stored, texts, type_of

MIN_WORDS = 5
POSITION = (*KEY, "pos")
# Words and counting lines before the first line of a prefix, and within the prefix.
AMOUNTS = ("before", "long_before", "words", "long")


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """POSITION, x, y (128 bits of the line's hash) and AMOUNTS of each line with a word; docs: from keyed()."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        owner, pos, high, low, words = [], [], [], [], []
        for d, text in enumerate(texts(piece)):
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            owner += [d] * len(lines)
            pos += range(len(lines))
            words += [len(x.split()) for x in lines]
            for x in lines:
                h = xxhash.xxh3_128_intdigest(x)
                high.append(h >> 64)
                low.append(h & 0xFFFFFFFFFFFFFFFF)
        owner, words = np.array(owner, np.int64), np.array(words, np.int64)
        long = (words >= min_words).astype(np.int64)
        first = np.searchsorted(owner, np.arange(piece.num_rows))

        def before(x: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(x))
            return sums[:-1] - sums[first[owner]]

        amounts = [before(words), before(long), words, long] if len(owner) else [words] * 4
        columns = [np.array(pos, np.int32), np.array(high, np.uint64).view(np.int64), np.array(low, np.uint64).view(np.int64), *(a.astype(np.int32) for a in amounts)]
        return pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(owner)) for k in KEY), *map(pa.array, columns)], [*POSITION, "x", "y", *AMOUNTS])

    return map_arrow(docs, make, f"doc_id {type_of(docs, 'doc_id')}, text_key long, pos int, x long, y long, before int, long_before int, words int, long int")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "pos")


def ranked(rows: DataFrame, depth: int, goes_on: bool = True) -> DataFrame:
    """POSITION, rank, later, AMOUNTS of the rows whose pair (x, y) occurs at several positions.

    Equal pairs have equal ranks, ordered as the pairs are; ``later`` says that the pair occurs earlier too. Where no
    longer prefix builds on these, the intervals are enough and the ranks stay NULL.
    """
    pairs = rows.groupBy("x", "y").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last")).filter("first <> last")
    if goes_on:
        pairs = pairs.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("rank", F.monotonically_increasing_id())
    else:
        pairs = pairs.withColumn("rank", F.lit(None).cast("long"))
    numbered = stored(pairs, f"ranks-{depth}")
    return stored(rows.join(numbered, ["x", "y"]).select(*POSITION, "rank", (_order() != F.col("first")).alias("later"), *AMOUNTS).distinct(), f"suffixes-{depth}")


def _pairs(known: DataFrame, shift: int) -> DataFrame:
    """Positions of which the own rank and that ``shift`` lines further on are known, with at most one line that counts by itself."""
    ahead = known.select(
        F.col("doc_id").alias("next_doc"), F.col("text_key").alias("next_key"), (F.col("pos") - shift).alias("next_pos"), F.col("rank").alias("y"), *(F.col(a).alias(f"next_{a}") for a in AMOUNTS)
    )
    on = (F.col("text_key") == F.col("next_key")) & (F.col("pos") == F.col("next_pos")) & F.col("doc_id").eqNullSafe(F.col("next_doc"))
    both = known.withColumnRenamed("rank", "x").join(ahead, on)
    words = (F.col("next_before") - F.col("before") + F.col("next_words")).alias("words")
    long = (F.col("next_long_before") - F.col("long_before") + F.col("next_long")).alias("long")
    return both.select(*POSITION, "x", "y", "before", "long_before", words, long).filter("long < 2")


def suffix_intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> dict[int, DataFrame]:
    """For each number of lines up to ``min_words``: POSITION, rank, later, AMOUNTS of the suffixes that share so many lines with another."""
    known = {1: ranked(line_table(docs, min_words), 1)}
    size = 1
    while size < min_words:
        for m in range(size + 1, min(2 * size, min_words) + 1):
            known[m] = ranked(_pairs(known[size], m - size), m, goes_on=m == 2 * size < min_words)
        size *= 2
    return known


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, gone: sorted numbers (among lines with a word) of the lines to delete; docs: from keyed()."""
    known = suffix_intervals(docs, min_words)
    runs = reduce(DataFrame.union, [k.filter(F.col("later") & (F.col("words") >= min_words)).select(*POSITION, F.lit(m).alias("size")) for m, k in known.items()])
    lines = runs.select(*KEY, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos"))
    return lines.groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def remove_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (struct of the columns of docs but ``text``), text without later copies, n_lines, n_removed, runs (first line and number of lines of each deleted run)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    source = keyed(docs, F.col("text").isNull().alias("none"), F.struct(*others).alias("row"))
    gone = stored(later_copies(keyed(docs), min_words), "deleted-lines")
    some, rest = may_contain(source, gone, "text_key")
    carried = ("text", "none", "row")
    rows = some.join(gone, same_key(some, gone), "left").select(*carried, "gone").union(rest.select(*carried, F.lit(None).cast("array<int>")))
    run = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32())]))

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, runs = [], [], []
        removed = piece.column("gone").to_pylist()
        for text, places, none in zip(texts(piece), removed, piece.column("none").to_pylist()):
            lines = text.split(b"\n")
            total.append(len(lines))
            deleted = []
            if places:
                counted = [i for i, x in enumerate(lines) if x and not x.isspace()]
                deleted = [counted[p] for p in places]
                away = set(deleted)
                text = b"\n".join(x for i, x in enumerate(lines) if i not in away)
            kept.append(None if none else text)
            edges = [i for i in range(len(deleted)) if not i or places[i] != places[i - 1] + 1]
            runs.append([{"line": deleted[a], "lines": b - a} for a, b in zip(edges, [*edges[1:], len(deleted)])])
        numbers = [pa.array(total, pa.int64()), pa.array([len(x or ()) for x in removed], pa.int64())]
        return pa.RecordBatch.from_arrays([piece.column("row"), pa.array(kept, pa.binary()).cast(pa.string()), *numbers, pa.array(runs, run)], ["row", "text", "n_lines", "n_removed", "runs"])

    return map_arrow(rows, make, f"row {type_of(rows, 'row')}, text string, n_lines long, n_removed long, runs array<struct<line:int,lines:int>>")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs with the later copies cut out of ``text``."""
    return remove_lines(docs, min_words).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
