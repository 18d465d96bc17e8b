"""Threshold-scaled sketches of documents, in built-in functions only.

A sketch keeps every distinct shingle hash below a fixed fraction, 1/``scale``, of the hash range, so its size follows the text. Which
hashes are kept does not depend on the text they come from: the sketch of two texts together is the union of their sketches, and
the share of one sketch that is in another estimates how much of one text is in the other, however unequal they are in length.
``likeness`` is the shared part of the union (0 to 1), ``containment`` the shared part of the first.

A shingle is five words ``[^\\x20\\x09-\\x0D]+`` as they are, joined by one space; a text of fewer words is one shingle; none has no shingles. A hash is the first 64 bits
of the shingle's MD5, in hex. A text none of whose hashes is below the limit keeps its least one, so that only texts without words have
empty sketches. A fingerprint is the kept hashes in ascending order, 16 hex digits each.

Edited texts. In the descending order of doc_id (NULL last; equal doc_ids with other texts by the hash of the text) each document's last third of
code points is replaced by the first as many of the next one's. Only doc_id, text hash and length are sorted; a text moves once to the length its predecessor
wants, and the wanted beginnings move to the predecessors.

Defined results: NULL texts are empty. Rows equal in doc_id and text are one document in the order and have equal results, one for each
row. A table of one document is its own next one. Two empty sketches have likeness and containment 1, an empty one and another 0 (containment of an empty sketch 1).
Texts of any length are read whole; memory follows the longest. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlight.llm.common import WORD, keyed, numbered, stored

SHINGLE, SCALE = 5, 4
DIGITS = 16


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _hashes(words: Column, shingle: int, first: Column | None = None) -> Column:
    """Hashes of the shingles from the first-th (from 0) on. concat_ws leaves out what a short text lacks."""
    first = F.lit(0) if first is None else first
    last = F.greatest(F.size(words) - shingle, F.lit(0))
    hashed = lambda i: F.left(F.md5(F.concat_ws(" ", *(F.get(words, i + k) for k in range(shingle)))), F.lit(DIGITS))
    return F.when((F.size(words) > 0) & (first <= last), F.transform(F.sequence(F.least(first, last), last), hashed)).otherwise(F.array().cast("array<string>"))


def _kept(every: Column, scale: int) -> Column:
    """Sorted distinct hashes below the limit, at least the smallest one."""
    limit = f"{(1 << 4 * DIGITS) // scale:0{DIGITS}x}" if scale > 1 else "g"

    def least(low: Column) -> Column:
        return F.when((F.size(low) > 0) | (F.size(every) == 0), F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(every)))

    return _let(F.filter(every, lambda h: h < limit), least)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The kept hashes of a text."""
    return _let(_let(_words(text), lambda w: _hashes(w, shingle)), lambda every: _kept(every, scale))


def sketches_before_and_after(text: Column, start: Column, edited: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sketches of a text and of an edited one that begins with ``start`` as the text does, in an array; shingles within the start are hashed once."""

    def both(every: Column) -> Column:
        # The last word of the start may be cut.
        same = F.greatest(F.size(_words(start)) - shingle, F.lit(0))
        rest = _let(_words(edited), lambda w: _hashes(w, shingle, same))
        return F.array(_kept(every, scale), _let(F.concat(F.slice(every, F.lit(1), same), rest), lambda e: _kept(e, scale)))

    return _let(_let(_words(text), lambda w: _hashes(w, shingle)), both)


def fingerprint(kept: Column) -> Column:
    return F.array_join(kept, "")


def hashes_of(written: Column) -> Column:
    """The sketch that a fingerprint stands for."""
    return F.regexp_extract_all(written, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Share of sketch ``a`` in ``b``: how much of the first text is in the second."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: DataFrame, by: str, column: str = "sketch") -> DataFrame:
    """by, hash: the sketch of all texts of a group together, a row for each hash, so that a group of any size is spread."""
    return sketches.select(by, F.explode(column).alias("hash")).distinct()


def followers(rows: DataFrame) -> DataFrame:
    """doc_id, text_key of each document, before_id, before_key of the one that comes before it in descending order of doc_id, and wanted, the third of that one's length."""
    light = rows.groupBy("doc_id", "text_key").agg(F.max(F.length("text")).alias("n"))
    order = stored(numbered(light, F.col("doc_id").desc_nulls_last(), F.col("text_key").desc()), "order")
    count = order.count()
    before = order.select(F.col("doc_id").alias("before_id"), F.col("text_key").alias("before_key"), F.floor(F.col("n") / 3).cast("int").alias("wanted"), ((F.col("place") + 1) % max(count, 1)).alias("next"))
    return order.join(before, order["place"] == before["next"]).select("doc_id", "text_key", "before_id", "before_key", "wanted")


# Equal and not NULL wherever doc_id and text are: one shuffle by them serves both joins and the aggregation.
_KEYS = ["text_key", "plain_id", "no_id"]


def _plain_id(column: str) -> dict[str, Column]:
    return {"plain_id": F.coalesce(F.col(column).cast("string"), F.lit("")), "no_id": F.col(column).isNull()}


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next (containment of the document in its edited text and in the next one)."""
    links = stored(followers(keyed(docs)), "followers")
    # Both joins read the same columns, so that one shuffle of the texts is used twice; doc_id comes back from its plain form.
    rows = keyed(docs).withColumns(_plain_id("doc_id")).select(*_KEYS, "text")
    # A document's beginning and sketch (as bytes) go to the one before it.
    print_bytes = F.unhex(fingerprint(sketch(F.col("text"), shingle, scale)))
    heads = rows.join(links.withColumns(_plain_id("doc_id")).drop("doc_id"), _KEYS)
    heads = heads.select(F.col("before_key").alias("text_key"), *(c.alias(k) for k, c in _plain_id("before_id").items()), F.substring("text", F.lit(1), F.col("wanted")).alias("head"), print_bytes.alias("next_print"))
    heads = heads.groupBy(*_KEYS).agg(F.first("head").alias("head"), F.first("next_print").alias("next_print"))
    found = rows.join(heads, _KEYS)
    n = F.length("text")
    start = F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int"))
    doc_id = F.when(~F.col("no_id"), F.col("plain_id").cast(docs.schema["doc_id"].dataType)).alias("doc_id")
    found = found.select(doc_id, "text", n.cast("long").alias("n_chars"), start.alias("start"), F.concat(start, "head").alias("edited"), "next_print")
    own = sketches_before_and_after(F.col("text"), F.col("start"), F.col("edited"), shingle, scale)
    found = found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), own.alias("own"), hashes_of(F.lower(F.hex("next_print"))).alias("next"))
    a, b, c = F.col("own")[0], F.col("own")[1], F.col("next")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"), containment(a, b).alias("in_edited"), containment(a, c).alias("in_next"),
    )
