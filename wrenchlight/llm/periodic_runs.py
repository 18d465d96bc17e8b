"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q and a length of at least max(24, 3 * q) that cannot be made longer. For each power of two L every
place gets a name for the L words from there on (equal names, equal words), made from the names of half the length. The successor of a place is the next one of
the same name. Within a window of twice the length, occurrences of a factor are an arithmetic progression, so a successor at most
L away proposes its distance as a period; stretches of neighbouring places with one distance d, L / 2 < d <= L, are one proposal.
A run of period d has such a factor at its start, as it is longer than d + L, and the factor's next occurrence is exactly d away, since no
shorter shift maps d words of smallest period d onto themselves; so each run is proposed at its one L. Proposals are extended word by word
and deduplicated by start and period.

Names are exact: words are numbered by their bytes, pairs of names by sorting. A place whose factor has no second occurrence in its document takes no further
part, since a longer factor there has none either; the work so follows the repetition that is there. Documents are handled together, some 2 MB of text at a time, a
longer one by itself.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; NULL and empty texts have no words and no runs. Every row gives a row; repeated rows give equal results.
Of runs with the same exact length over period the one with the smallest start, then period, is the best. Extra columns are ignored. An empty table
gives an empty result. Memory follows the longest text, some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.common import map_arrow, texts, type_of

LEAST, TIMES = 24, 3


def names_of(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def proposals(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of stretches with a period. names: of the words of documents behind one another; owner: the document of each word, ascending."""
    n = len(names)
    ends = np.searchsorted(owner, owner, side="right")
    found, places, span = [], np.arange(n), 1
    while len(places):
        # Places of one name in one document, in order; the next in this order is the successor.
        by = np.lexsort((places, names[places], owner[places]))
        at = places[by]
        same = (names[at[1:]] == names[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
        successor = np.zeros(n, np.int64)
        successor[at[:-1][same]] = at[1:][same]
        starts = np.flatnonzero(successor)
        distance = successor[starts] - starts
        near = (2 * distance > span) & (distance <= span)
        starts, distance = starts[near], distance[near]
        if len(starts):
            new = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (distance[1:] != distance[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])])
            last = np.r_[new[1:], len(starts)] - 1
            found.append(np.stack([starts[new], starts[last] + span + distance[last], distance[new]], axis=1))
        twice = np.zeros(n, bool)
        twice[at[1:][same]] = twice[at[:-1][same]] = True
        # A factor of 2 * span is named by its halves, each of which has to occur twice.
        half = np.flatnonzero(twice)
        half = half[half + 2 * span <= ends[half]]
        half = half[twice[half + span]]
        if not len(half):
            break
        _, inverse = np.unique(names[half] * np.int64(n) + names[half + span], return_inverse=True)
        names = np.zeros(n, np.int64)
        names[half] = inverse
        places, span = half, 2 * span
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def extended(ids: np.ndarray, owner: np.ndarray, proposed: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Proposals (start, end, period) made as long as they go, those long enough, each once: rows (start, length, period) by start and period."""
    n = len(ids)
    start, end, period = proposed.T.copy()
    going = np.arange(len(start))
    while len(going):
        s = start[going] - 1
        at = np.maximum(s, 0)
        ok = (s >= 0) & (ids[at] == ids[at + period[going]]) & (owner[at] == owner[start[going]])
        going = going[ok]
        start[going] -= 1
    going = np.arange(len(end))
    while len(going):
        at = np.minimum(end[going], n - 1)
        ok = (end[going] < n) & (ids[at] == ids[at - period[going]]) & (owner[at] == owner[start[going]])
        going = going[ok]
        end[going] += 1
    length = end - start
    long = length >= np.maximum(least, times * period)
    return np.unique(np.stack([start, period, length], axis=1)[long], axis=0)[:, [0, 2, 1]]


def spread_period(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words with a period from a place on, in one of ten documents by the CRC-32 of its id; ids that are NULL keep theirs."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, best run, digests, kept words of a document; runs: start, length, period."""
    best = (None, None, None, None)
    if runs:
        start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        stays = np.cumsum(gone)[:-1] == 0
        words = [words[i] for i in np.flatnonzero(stays)]
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = b" ".join(words)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode())


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, text string, runs array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, change=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the best run, runs_sha256, collapsed_sha256, text (the words that stay), runs.

    ``change(words, doc_id)`` may replace the words of a document first.
    """

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = piece.column("doc_id")
        every = [t.split() for t in texts(piece)]
        if change is not None:
            every = [change(w, i) for w, i in zip(every, ids.to_pylist())]
        sizes = np.array([len(w) for w in every], np.int64)
        first = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(every)), sizes)
        flat = [w for words in every for w in words]
        runs = np.zeros((0, 3), np.int64)
        if flat:
            names = names_of(flat)
            proposed = proposals(names, owner)
            if len(proposed):
                runs = extended(names, owner, proposed, least, times)
        bounds = np.searchsorted(runs[:, 0], first)
        rows = []
        for i, words in enumerate(every):
            own = runs[bounds[i] : bounds[i + 1]] - [first[i], 0, 0]
            own = [tuple(r) for r in own.tolist()]
            rows.append((*described(words, own), [dict(zip(("start", "length", "period"), r)) for r in own]))
        names_and_types = [f.split(" ", 1) for f in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "string": pa.string()}
        runs_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        arrays = [pa.array([r[k] for r in rows], types.get(kind, runs_type)) for k, (_, kind) in enumerate(names_and_types)]
        return pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *(n for n, _ in names_and_types)])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(source, make, f"doc_id {type_of(docs, 'doc_id')}, {SCHEMA}")
