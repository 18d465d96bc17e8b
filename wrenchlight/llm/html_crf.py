"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (the text between two block-level tags) with their ancestor tags, by a scanner that goes over the page
once, forward. Features are the ancestor tags, the words of the ancestors' class, id and role (hashed, with a mark for those of the nearest one), and the text. The chain's two labels
are article and other; weights are the maximum of the conditional likelihood of labelled pages with a Gaussian prior around 0, found by gradient steps over
forward-backward sums, and pages are decoded by Viterbi. No weight is set by hand: a word that training has not seen weighs nothing.

Labelled pages: a page whose URL ends in a document's number; a block is article if its text is in the document (short blocks:
is a whole line of it). At most ``sample`` pages, those with the least hashes of page_id, are used; they are small enough for one task. As the pages of one site say little about
others, they are trained on as they are and, about ``made_up`` times in all, with their blocks moved into other layouts (``page_layouts``), whose containers and names are drawn at random and partly mislead. All
pages are decoded.

Defined results: NULL html is empty; a page without article blocks has the text ''. Unclosed tags, comments and scripts end where
HTML ends them, at the latest with the page; a quote that never closes does not hold its tag open beyond the next ``>``. Character references are decoded, white space within a block becomes
one space, blocks are joined by one space. Every row gives a row. Without labelled pages only made-up layouts of filler text are trained on. Pages of any length are scanned whole, in time
in proportion to it. Extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import html
import json
import random
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.common import map_arrow, stored, type_of
from wrenchlight.llm.page_layouts import FILLER, MARK, layout

SAMPLE, MADE_UP = 240, 480
# What HTML's tags are for.
RAW = frozenset("script style noscript template svg iframe object math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
SELF_CLOSING = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
HOLDERS = frozenset("html body article aside main section div nav header footer form table td th ul ol dl blockquote details dialog fieldset figure button".split())
# Ancestors that are features; those that hold a part of a page are also marked where they are the nearest.
PARTS = frozenset("nav header footer aside form article main section figure blockquote button select menu dialog search fieldset label option textarea".split())
ANCESTORS = (*sorted(PARTS), "ul", "ol", "table", "a", "pre", "details")

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I) for name in RAW}

SLOTS = 1 << 12  # of hashed words
TEXT_FEATURES = (
    "bias", "p", "heading", "li", "other tag", "links", "some links", "1 word", "2-4 words", "5-14 words", "15-49 words", "50+ words",
    "stop at end", "commas", "copyright", "first", "last", "unnamed", *(f"in {a}" for a in ANCESTORS), *(f"nearest {a}" for a in sorted(PARTS)),
)
_INDEX = {f: i for i, f in enumerate(TEXT_FEATURES)}
WIDTH = len(TEXT_FEATURES) + SLOTS
_SEEN = frozenset(ANCESTORS)
_KINDS = {"p": _INDEX["p"], "li": _INDEX["li"], **{f"h{k}": _INDEX["heading"] for k in range(1, 7)}}


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text and tags of a page in order: (text before it, name, closes, attributes), at the end with name ''. One forward scan.

    Comments, declarations and the contents of RAW elements are left out.
    """
    at, begin, n = 0, 0, len(page)
    absent = {'"': n, "'": n}  # from where on a quote does not occur any more
    while True:
        at = page.find("<", at)
        if at < 0 or at == n - 1:
            yield page[begin:], "", False, ""
            return
        after = page[at + 1]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[begin:at], "!", False, ""
            at = begin = n if end < 0 else end + 3
        elif after in "!?":
            end = page.find(">", at)
            yield page[begin:at], "!", False, ""
            at = begin = n if end < 0 else end + 1
        elif found := _NAME.match(page, at + 2 if after == "/" else at + 1):
            name, stop = found[0].lower(), found.end()
            while True:
                mark = _STOP.search(page, stop)
                if mark is None:
                    stop = -1
                    break
                quote, stop = mark[0], mark.end()
                if quote == ">":
                    break
                closing = page.find(quote, stop) if stop < absent[quote] else -1
                if closing < 0:
                    absent[quote] = min(absent[quote], stop)
                else:
                    stop = closing + 1
            text = page[begin:at]
            if stop < 0:  # a tag that never ends
                yield text, "", False, ""
                return
            attributes = page[found.end() : stop - 1]
            at = begin = stop
            if after != "/" and name in RAW and not attributes.endswith("/"):
                yield text, "!", False, ""
                end = _ENDS[name].search(page, stop)
                close = page.find(">", end.end()) if end else -1
                at = begin = n if close < 0 else close + 1
            else:
                yield text, name, after == "/", attributes
        else:
            at += 1


class _Open:
    """The open elements, with what is asked of them kept up to date as they open and close."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        # Of the block elements, holders, parts and elements with words: their places, and what they are.
        self.blocks: list[int] = []
        self.holders: list[int] = []
        self.named: list[tuple[int, str, tuple[int, ...]]] = []
        self._above: list[int] | None = None  # features of all but the block, until one of them changes

    def open(self, name: str, words: tuple[int, ...]) -> None:
        place = len(self.names)
        self.names.append(name)
        self.places.setdefault(name, []).append(place)
        if name in BLOCK:
            self.blocks.append(place)
        if name in HOLDERS:
            self.holders.append(place)
        if words or name in PARTS:
            self.named.append((place, name, words))
        if words or name in _SEEN:
            self._above = None

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def close_to(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.places[name].pop()
            if name in _SEEN:
                self._above = None
        for kept in (self.blocks, self.holders):
            while kept and kept[-1] >= place:
                kept.pop()
        while self.named and self.named[-1][0] >= place:
            self.named.pop()
            self._above = None

    def features(self) -> list[int]:
        """Of the ancestors of a block."""
        block = self.names[self.blocks[-1]] if self.blocks else ""
        if self._above is None:
            self._above = self._around()
        return [_KINDS.get(block, _INDEX["other tag"]), *self._above]

    def _around(self) -> list[int]:
        out = [_INDEX[f"in {a}"] for a in ANCESTORS if self.places.get(a)]
        if not self.named:
            out.append(_INDEX["unnamed"])
        for place, name, words in self.named[-1:]:
            if name in PARTS:
                out.append(_INDEX[f"nearest {name}"])
            out += [slot_of("nearest", w) for w in words]
        # The words of the eight nearest named ancestors, so that depth does not add up.
        out += sorted({w for _, _, words in self.named[-8:] for w in words})
        return out


def slot_of(*key: object) -> int:
    return len(TEXT_FEATURES) + zlib.crc32(":".join(map(str, key)).encode()) % SLOTS


def words_of(attributes: str) -> tuple[int, ...]:
    """Hashed words of class, id and role, with their first five letters."""
    found = {w for a in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((a[1] or a[2] or a[3] or "").lower())}
    return tuple(sorted({slot_of(w) for w in found} | {slot_of("starts", w[:5]) for w in found if len(w) >= 5}))


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """Text and features of the leaf blocks, in page order."""
    found: list[tuple[str, list[int], float]] = []
    opened = _Open()
    text: list[str] = []
    linked = 0
    context: list[int] | None = None

    def close() -> None:
        nonlocal linked, context
        raw = "".join(text) if context is not None else ""
        joined = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if joined:
            found.append((joined, context, linked / len(joined)))
        text.clear()
        linked, context = 0, None

    for raw, name, closes, attributes in tags(page):
        if raw and not opened.places.get("head") and not opened.places.get("title"):
            text.append(raw)
            if not raw.isspace():
                if context is None:
                    context = opened.features()
                if opened.places.get("a"):
                    linked += len(raw)
        if name in ("", "!"):
            continue
        if name in BLOCK:
            close()
        if name == "br":
            text.append(" ")
        elif closes:
            if (place := opened.last(name)) >= 0:
                opened.close_to(place)
        elif name not in VOID and not attributes.endswith("/"):
            if name in BLOCK:
                if name != "title" and opened.names and opened.names[-1] in ("head", "title"):
                    opened.close_to(max(0, min(p for p in (opened.last("head"), opened.last("title")) if p >= 0)))
                place = max(map(opened.last, SELF_CLOSING.get(name, ("p",))))
                if place >= 0 and place >= (opened.holders[-1] if opened.holders else 0):
                    opened.close_to(place)
            opened.open(name, words_of(attributes) if attributes and name not in ("html", "body") else ())
    close()
    out = []
    for joined, above, links in found:
        n = joined.count(" ") + 1
        f = [_INDEX["bias"], _INDEX["1 word" if n == 1 else "2-4 words" if n < 5 else "5-14 words" if n < 15 else "15-49 words" if n < 50 else "50+ words"]]
        if links:
            f.append(_INDEX["links" if links > 0.5 else "some links"])
        if joined[-1] in ".!?…”\"":
            f.append(_INDEX["stop at end"])
        if "," in joined:
            f.append(_INDEX["commas"])
        if "©" in joined:
            f.append(_INDEX["copyright"])
        out.append((joined, f + above))
    if out:
        out[0][1].append(_INDEX["first"])
        out[-1][1].append(_INDEX["last"])
    return out


def scores_of(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each block's features."""
    if not features:
        return np.zeros(0)
    sizes = np.array([len(f) for f in features])
    columns = np.fromiter(chain.from_iterable(features), np.int64, sizes.sum())
    return np.add.reduceat(weights[columns], np.r_[0, np.cumsum(sizes)[:-1]])


def train(pages: list[tuple[list[list[int]], np.ndarray]], steps: int = 90, rate: float = 0.1, variance: float = 1.0) -> np.ndarray:
    """Weights of the features for label 1, then of the transitions 00, 01, 10, 11, from (features, labels) of pages."""
    weights = np.zeros(WIDTH + 4)
    pages = [p for p in pages if len(p[1])]
    if not pages:
        return weights
    n, longest = len(pages), max(len(y) for _, y in pages)
    y, used = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (_, b) in enumerate(pages):
        y[i, : len(b)], used[i, : len(b)] = b, True
    every = [f for a, _ in pages for f in a]
    columns = np.fromiter(chain.from_iterable(every), np.int64)
    rows = np.repeat(np.arange(len(every)), [len(f) for f in every])
    starts = np.searchsorted(rows, np.arange(len(every)))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    seen = np.zeros(WIDTH + 4)
    seen[:WIDTH] = np.bincount(columns, weights=y[used][rows].astype(float), minlength=WIDTH)
    seen[WIDTH:] = np.bincount((2 * y[:, :-1] + y[:, 1:])[used[:, 1:]], minlength=4)
    for step in range(1, steps + 1):
        score, t = np.zeros((n, longest)), weights[WIDTH:].reshape(2, 2)
        score[used] = np.add.reduceat(weights[columns], starts)
        node = np.stack([np.zeros_like(score), score], axis=-1)
        ahead, back = np.zeros_like(node), np.zeros_like(node)
        ahead[:, 0] = node[:, 0]
        for k in range(1, longest):
            ahead[:, k] = np.where(used[:, k, None], np.logaddexp(ahead[:, k - 1, 0, None] + t[0], ahead[:, k - 1, 1, None] + t[1]) + node[:, k], ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            nxt = node[:, k + 1] + back[:, k + 1]
            back[:, k] = np.where(used[:, k + 1, None], np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None]), 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[..., 1] + back[..., 1] - total[:, None])
        expected = np.zeros_like(seen)
        expected[:WIDTH] = np.bincount(columns, weights=one[used][rows], minlength=WIDTH)
        both = ahead[:, :-1, :, None] + t + (node + back)[:, 1:, None, :] - total[:, None, None, None]
        expected[WIDTH:] = (np.exp(both) * used[:, 1:, None, None]).sum((0, 1)).ravel()
        gradient = (seen - expected - weights / variance) / n
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def viterbi(features: list[list[int]], weights: np.ndarray) -> list[int]:
    """The most likely labels."""
    scores = scores_of(features, weights).tolist()
    t00, t01, t10, t11 = weights[WIDTH:].tolist()
    zero, one, came = 0.0, 0.0, []
    for k, s in enumerate(scores):
        if k:
            a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
            came.append((b > a, d > c))
            zero, one = max(a, b), max(c, d) + s
        else:
            one = s
    label = int(one > zero)
    path = [label] if scores else []
    for back in reversed(came):
        label = int(back[label])
        path.append(label)
    return path[::-1]


def labels_of(rows: list[str], document: str) -> np.ndarray:
    whole = " ".join(document.split())
    lines = {" ".join(x.split()) for x in document.split("\n")}
    return np.array([int(r in lines or (r.count(" ") >= 3 and r in whole)) for r in rows], int)


def examples(page: str, document: str, layouts: int) -> list[tuple[list[list[int]], np.ndarray]]:
    """Features and labels of a labelled page, as it is and in other layouts."""
    found = blocks(page)
    y = labels_of([b for b, _ in found], document)
    # Long pages are cut into stretches, so that one of them does not widen the arrays of all.
    made = [([f for _, f in found[i : i + 200]], y[i : i + 200]) for i in range(0, len(found), 200)]
    inside, outside = [b for (b, _), k in zip(found, y) if k][:40], [b for (b, _), k in zip(found, y) if not k][:40]
    return made + moved(inside, outside, layouts, zlib.crc32(document.encode()))


def moved(inside: list[str], outside: list[str], layouts: int, seed: int) -> list[tuple[list[list[int]], np.ndarray]]:
    """Pages of other layouts from the blocks of an article and of the rest of its page, with labels."""
    out = []
    for k in range(layouts):
        found = blocks(layout(inside or FILLER[:3], outside or FILLER[3:], random.Random(seed * 1009 + k)))
        out.append(([f for _, f in found], np.array([b.startswith(MARK) for b, _ in found], int)))
    return out


def labelled(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """html, document of at most ``sample`` pages whose URL ends in a doc_id."""
    number = F.regexp_extract(F.col("url"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    chosen = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc")).filter("doc is not null and page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = F.broadcast(stored(chosen, "labelled-pages"))  # at most ``sample`` rows of two numbers
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == chosen["doc"]).select("page_id", F.col("text").alias("document"))
    texts = stored(texts.limit(sample), "labels")
    return pages.select("page_id", "html").join(F.broadcast(texts), "page_id").select("html", "document").limit(sample)


def fit(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE, made_up: int = MADE_UP) -> np.ndarray:
    """Weights trained on a bounded sample of labelled pages, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [(p, d) for b in batches for p, d in zip(b.column("html").to_pylist(), b.column("document").to_pylist()) if p and d]
        layouts = -(-made_up // max(1, len(given)))
        rows = [e for page, document in given for e in examples(page, document, layouts)] or moved([], [], made_up, 0)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(train(rows).tolist())])], ["weights"])

    spark = pages.sparkSession
    nothing = spark.createDataFrame([(None, None)], "html string, document string")  # so that the task also runs without labelled pages
    made = labelled(pages, docs, sample).unionByName(nothing).coalesce(1).mapInArrow(run, "weights string").collect()
    return np.array(json.loads(made[0][0]))


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each page."""

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for page in piece.column("html").to_pylist():
            found = blocks(page or "")
            path = viterbi([f for _, f in found], weights)
            texts.append(" ".join(b for (b, _), y in zip(found, path) if y))
            counts.append(len(found))
        numbers = [pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "n_blocks"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(source, make, f"page_id {type_of(pages, 'page_id')}, url string, text string, n_chars long, n_blocks long", "html")


def main_texts(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return extract(pages, fit(pages, docs, sample))
