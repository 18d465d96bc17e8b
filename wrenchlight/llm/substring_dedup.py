"""Substring dedup: Relative Lempel-Ziv parsing of every document against all blocks of the corpus.

Index. Of each window of ``window`` words the least hash of its ``gram``-word grams is the anchor, so equal windows have equal anchors.
The stretch of words under all neighbouring windows with the same anchor is a block. All blocks of all
documents are the reference, indexed by anchor, then by the hash of the block.

Parsing. A block that also occurs elsewhere is matched as a whole, and greedy factors are runs of such blocks. An
anchor that occurs elsewhere only within other blocks is a factor boundary: there, and only there, single
windows are looked up among those of all blocks with such an anchor. Matched windows that touch or overlap make
a factor of at least ``window`` words, which is a duplicate span. The result equals a comparison of all windows
(64-bit hashes of words, windows and blocks stand for them).

A block costs about 1/15 of a word's row, most anchors are unique and leave after one aggregation, and texts are shuffled
only where a document has a boundary or a span (behind a filter of bounded size). Anchors and windows are counted by
partial aggregation and joined back, so a passage in a third of all documents is spread over tasks.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; NULL and empty texts have none. Fewer words than a
window: nothing is removed. All copies are removed, the first included. Repeated rows count as copies of each other; each row is
in the result. Documents are told apart by doc_id (NULL allowed) and text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.arrays import buffer_of, sliding_argmin, word_ranges, words_of
from wrenchlight.llm.common import KEY, keyed, map_arrow, may_contain, same_key, stored, texts, type_of

WINDOW, GRAM = 35, 8


def _blocks(texts: pa.Array, window: int, gram: int):
    """Of all blocks: document, first and last window (as word numbers in the document), hash of the anchor, of the block; and a function for window hashes."""
    data, offsets = buffer_of(texts)
    starts, ends, first = words_of(data, offsets)
    if len(starts) < window:
        return None
    ranges = word_ranges(data, starts, ends)
    n = len(starts)
    grams = ranges.hashes(np.arange(n - gram + 1), np.arange(gram, n + 1))
    anchor = sliding_argmin(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n - window + 1)
    at = at[owner[at] == owner[at + window - 1]]
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    doc = owner[begin]
    return doc, begin - first[doc], end - first[doc], grams[anchor[begin]], ranges.hashes(begin, end + window), ranges, first


def blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, anchor, block, lo, hi: one row for each block; lo and hi number the first words of its first and last window."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _blocks(piece.column("text"), window, gram)
        if found is None:
            return None
        doc, lo, hi, anchor, block = found[:5]
        keys = [piece.column(k).take(pa.array(doc)) for k in KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], [*KEY, "anchor", "block", "lo", "hi"])

    return map_arrow(docs, make, f"doc_id {type_of(docs, 'doc_id')}, text_key long, anchor long, block long, lo int, hi int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, lo, single, window hash of each window of the blocks in ``todo`` (structs lo, hi, single)."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = buffer_of(piece.column("text"))
        starts, ends, first = words_of(data, offsets)
        todo = piece.column("todo")
        flat = todo.flatten()
        doc = np.repeat(np.arange(len(todo)), np.diff(todo.offsets.to_numpy()))
        lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
        single = flat.field("single").to_numpy(zero_copy_only=False)
        counts = (hi - lo + 1).astype(np.int64)
        block = np.repeat(np.arange(len(lo)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[block]
        at = place + first[doc[block]]
        found = word_ranges(data, starts, ends).hashes(at, at + window)
        keys = [piece.column(k).take(pa.array(doc[block])) for k in KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int32)), pa.array(single[block]), pa.array(found.view(np.int64))], [*KEY, "lo", "single", "hash"])

    return map_arrow(docs, make, f"doc_id {type_of(docs, 'doc_id')}, text_key long, lo int, single boolean, hash long")


def matches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, lo, hi: stretches of windows (first words numbered from 0) that occur elsewhere too; docs: from keyed()."""
    found = blocks(docs, window, gram)
    # Written before it is joined back: the join then has a plain shuffle on either side, which AQE can split at a frequent anchor.
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).filter("n > 1")
    anchors = stored(anchors.select("anchor", (F.col("low") == F.col("high")).alias("whole")), "anchors")
    shared = stored(found.join(anchors, "anchor"), "shared-blocks")
    # Anchors of several blocks: one representative of each block, and how often the block occurs.
    edge = shared.filter("not whole")
    known = stored(
        edge.groupBy("anchor", "block").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*KEY, "lo", "hi"))), "boundary-blocks"
    )
    repeated = edge.join(known.filter("n > 1").select("anchor", "block"), ["anchor", "block"])
    todo = known.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", (F.col("n") == 1).alias("single"))).alias("todo"))
    some, _ = may_contain(docs, todo, "text_key")
    windows = _windows(some.join(todo, same_key(some, todo)).select(some["doc_id"], some["text_key"], "text", "todo"), window)
    windows = stored(windows, "boundary-windows")
    again = stored(windows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "boundary-hashes")
    alone = windows.filter("single").join(again, "hash").select(*KEY, "lo", F.col("lo").alias("hi"))
    return shared.filter("whole").select(*KEY, "lo", "hi").union(repeated.select(*KEY, "lo", "hi")).union(alone)


def _covered(n_words: int, stretches: list[dict] | None, window: int) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int64)
    for s in stretches or ():
        steps[s["lo"]] += 1
        steps[s["hi"] + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), kept_sha256, factors (array of word ranges [start, end)) for each row of docs."""
    docs = keyed(docs)
    spans = stored(matches(docs, window, gram), "matches").groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = stored(spans, "spans")
    some, rest = may_contain(docs, spans, "text_key")
    joined = some.join(spans, same_key(some, spans), "left").select(some["doc_id"], "text", "spans")
    rows = joined.union(rest.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType)))

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(texts(piece), piece.column("spans").to_pylist()):
            words = text.split()
            gone = _covered(len(words), found, window)
            steps = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            kept = b" ".join(w for w, g in zip(words, gone) if not g) if found else b" ".join(words)
            out.append((len(words), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(steps[::2], steps[1::2])]))
        columns = list(zip(*out))
        factors = pa.array(columns[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3]), factors],
            ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "factors"],
        )

    return map_arrow(rows, make, f"doc_id {type_of(docs, 'doc_id')}, n_words long, n_removed long, kept string, kept_sha256 string, factors array<struct<start:int,end:int>>")
