"""Words of many documents at once as numpy arrays: where they are, 64-bit hashes of words and of word ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1), modulo 2**64; the longest so far are remembered."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each number over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of ranges of a sequence from prefix sums: equal ranges have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        self.back = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + length * np.uint64(_BASE))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, and where each begins (and the last ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the number of the first word of each document (and the total)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time, mixed after each step; ranges beyond ``LONG_WORD`` bytes by XXH3. Up to eight bytes, ranges of one length never collide."""
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    going = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    step = 0
    while len(going):
        lane = eights[starts[going] + step].view(np.uint64)[:, 0]
        left = np.minimum(sizes[going] - step, 8).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
        out[going] = mixed((out[going] ^ lane) * np.uint64(_WORD_BASE))
        step += 8
        going = going[sizes[going] > step]
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ranges:
    """Hashes of word ranges, from hashes of words, from their bytes."""
    return Ranges(word_hashes(data, starts, ends), _WORD_BASE)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the leftmost place of the least of ``width`` values."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        have += step
    return at
