"""Quality rules from tokeniser fertility, with rejection bands per language or script.

Two public vocabularies measure each document, word by word with a leading space (both cut at white space
before merging): a piece vocabulary with byte fallback gives characters per token, the share of byte-fallback tokens and the
entropy of the document's tokens; a byte-level vocabulary gives characters per token once more. Text unlike its
language (shouting, symbols, encoded data, word lists, other scripts) leaves the range of its language.

Bands: for each group (``lang``; the script where it is NULL) the median and the quartile range of each measure over all
documents that pass the base rules. A document is rejected if a measure lies more than ``width`` spreads away. The spread adds
what chance does to short texts (``noise`` / tokens) and has a floor (``floor``), so that a very even group rejects nothing ordinary.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; NULL and empty texts have none and fail the base rules.
Repeated rows count and are judged alike. Documents are told apart by doc_id (NULL allowed) and text. A table
without ``lang`` is grouped by script. Other columns are ignored. Words longer than 256 code points are measured in parts.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.arrays import SPACE, buffer_of, mixed, word_ranges, words_of
from wrenchlight.llm.common import KEY, keyed, map_arrow, same_key, stored, texts, type_of

VOCABULARIES = "/opt/tokenizers"
# Names of the vocabulary files, and the pre-tokeniser pattern that belongs to the byte-level one.
PIECES, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = b"#*$%&|<>"
# Scripts by the first byte of their characters in UTF-8, as far as it tells them apart.
SCRIPTS = {
    "latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "hebrew": [0xD7], "arabic": [0xD8, 0xD9, 0xDA, 0xDB], "indic": [0xE0], "kana": [0xE3], "han": [0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9], "hangul": [0xEA, 0xEB, 0xEC],
}
OTHER, SYMBOL, LATER, WHITE = 10, 11, 12, 13
MEASURES = ("chars_per_piece", "byte_share", "entropy", "chars_per_byte_token")
WORD_PART = 256


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    # Width and noise: the most junk caught with at most 0.5 % of the clean documents lost, on one half of labelled rows (README).
    width: float = 3.5
    # By measure: smallest spread, and the variance that one token adds.
    floor: tuple[float, ...] = (0.03, 0.01, 0.02, 0.03)
    noise: tuple[float, ...] = (0.5, 0.25, 0.1, 4.0)


class Vocabularies:
    """Tokens of words."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))
        with open(os.path.join(folder, BYTE_LEVEL), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all words behind one another, how many each word has, and how many byte-level tokens."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = b"\n".join(words).decode("utf-8", "replace").split("\n")
        long = [i for i, w in enumerate(whole) if len(w) > WORD_PART]
        parts = {i: [whole[i][k : k + WORD_PART] for k in range(0, len(whole[i]), WORD_PART)] for i in long}
        ids = self.pieces.encode(["" if i in parts else w for i, w in enumerate(whole)] if parts else whole, num_threads=1)
        for i, mine in parts.items():
            ids[i] = [t for found in self.pieces.encode(mine, num_threads=1) for t in found]
        ids = [x or [0] for x in ids]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        # One call for all words: the tokeniser cuts at the spaces between them; lengths in bytes tell whose a token is.
        text = " " + " ".join(" ".join(parts[i]) if i in parts else w for i, w in enumerate(whole))
        ends = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for i in long:
            ends[i] += len(parts[i]) - 1
        ends = np.cumsum(ends)
        token_ends = np.cumsum(self.length[np.array(self.bytes.encode_ordinary(text), np.int64)])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size, np.diff(np.searchsorted(token_ends, ends, "right"), prepend=0)


def _repeat_words(ranges, owner: np.ndarray, size: int = 3) -> np.ndarray:
    """For each word, whether a window of ``size`` words over it occurs again in its document."""
    n = len(owner)
    cover = np.zeros(n, bool)
    at = np.arange(max(0, n - size + 1))
    at = at[owner[at] == owner[at + size - 1]]
    if len(at):
        key = mixed(ranges.hashes(at, at + size) ^ mixed(owner[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = at[order[np.append(same, False) | np.append(False, same)]]
        for i in range(size):
            cover[again + i] = True
    return cover


def _entropy(tokens: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Bits per token of each document's token distribution, as a share of what as many different tokens would have."""
    top = int(tokens.max(initial=0)) + 1
    keys = np.sort((owner * top + tokens).astype(np.int32 if docs * top < 1 << 31 else np.int64))
    edge = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(edge, append=len(keys))
    total = np.bincount(owner, minlength=docs).astype(float)
    used = np.bincount(keys[edge] // top, weights=counts * np.log2(counts), minlength=docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(total) - used / total
        return np.where(total > 1, bits / np.log2(np.maximum(total, 2)), 0.0)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")


def _measure(piece: pa.RecordBatch, known: Vocabularies) -> pa.RecordBatch:
    data, offsets = buffer_of(piece.column("text"))
    starts, ends, first = words_of(data, offsets)
    docs, raw = len(offsets) - 1, data.tobytes()

    def per_doc(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[edges[1:]] - sums[edges[:-1]]

    ranges = word_ranges(data, starts, ends)
    owner = np.repeat(np.arange(docs), np.diff(first))
    # One count of (document, class of byte): white space, symbols, first bytes by script, other first bytes, later bytes.
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = LATER
    for k, leads in enumerate(SCRIPTS.values()):
        kind[leads] = k
    kind[SPACE], kind[list(SYMBOLS)] = WHITE, SYMBOL
    seen = np.bincount(np.repeat(np.arange(docs, dtype=np.int64) * 16, np.diff(offsets)) + kind[data], minlength=16 * docs).reshape(docs, 16)
    chars = seen[:, :LATER].sum(axis=1)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts(piece)]
    duplicate = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    # Each different word of the piece is encoded once.
    _, place, which = np.unique(ranges.hashes(np.arange(len(starts)), np.arange(1, len(starts) + 1)), return_index=True, return_inverse=True)
    flat, size, byte_size = known.encode([raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
    begin = np.cumsum(size) - size
    counts = size[which]
    total = int(counts.sum())
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[which], counts)
    tokens = flat[at].astype(np.int64)
    n_tokens = per_doc(counts, first)
    n_bytes = per_doc(byte_size[which], first)
    fallback = np.bincount(np.repeat(owner, counts), weights=known.fallback[tokens], minlength=docs)
    entropy = _entropy(tokens, np.repeat(owner, counts), docs)
    numbers = (np.diff(first), chars, seen[:, SYMBOL], duplicate, per_doc(_repeat_words(ranges, owner), first), n_tokens)
    names = [*SCRIPTS]
    measures = (chars / np.maximum(n_tokens, 1), fallback / np.maximum(n_tokens, 1), entropy, chars / np.maximum(n_bytes, 1))
    return pa.RecordBatch.from_arrays(
        [*(piece.column(c) for c in (*KEY, "lang")), pa.array([f"script {names[i]}" for i in seen[:, : len(SCRIPTS)].argmax(axis=1)]), *(pa.array(x.astype(np.int64)) for x in numbers), *(pa.array(x) for x in measures)],
        [*KEY, "lang", "script", *COLUMNS, *MEASURES],
    )


def measured(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, text_key, lang, script, the base counts and the four measures of each row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = keyed(docs, lang.alias("lang"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key long, lang string, script string, " + ", ".join([*(f"{c} long" for c in COLUMNS), *(f"{c} double" for c in MEASURES)])
    known: list[Vocabularies] = []  # filled in each worker's task

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not known:
            known.append(Vocabularies(folder))
        return _measure(piece, known[0])

    return map_arrow(source, make, schema)


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def judged(docs: DataFrame, rules: Rules = Rules(), folder: str = VOCABULARIES) -> DataFrame:
    """Each row's counts and measures, base_failed, reasons (measures out of band) and kept."""
    group = F.coalesce("lang", "script")
    rows = stored(measured(docs, folder).withColumn("base_failed", base_failed(rules)).withColumn("band_of", group), "measures")
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(f"q_{m}") for m in MEASURES]
    bands = stored(rows.filter("not base_failed").groupBy("band_of").agg(*quartiles), "bands")
    found = rows.join(bands, "band_of", "left")

    def outside(m: str, floor: float, noise: float) -> Column:
        q = F.col(f"q_{m}")
        usual = F.greatest((q[2] - q[0]) / 1.349, F.lit(floor))
        spread = F.sqrt(usual * usual + F.lit(noise) / F.greatest(F.col("n_tokens"), F.lit(1)))
        return F.when(F.abs(F.col(m) - q[1]) > rules.width * spread, F.lit(m))

    reasons = F.array_compact(F.array(*(outside(*x) for x in zip(MEASURES, rules.floor, rules.noise))))
    found = found.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return found.select(*KEY, *COLUMNS, *MEASURES, "band_of", "base_failed", "reasons", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules(), folder: str = VOCABULARIES) -> DataFrame:
    """The rows of docs that pass, as they are."""
    good = judged(docs, rules, folder).filter("kept").select(*KEY).distinct()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(good, same_key(rows, good), "left_semi").select("row.*")
