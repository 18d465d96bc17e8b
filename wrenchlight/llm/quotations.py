"""Chat formatting by quotation linking.

A message's lines have a quote level (the number of leading '>' marks). Neighbouring lines of a level are a passage. Quoted
passages and their lines are normalised (lower case, letters and digits, one space) and hashed, and joined with the hashes of
what messages say themselves: the earliest message of the conversation that says it is the original. A message
replies to the original of which it quotes most words at the lowest level that has one known (the later one of equals); where level 1 was trimmed or wrapped anew,
that is the original of a nested quote. All links, nested ones too, are a column. The result has the
messages without quotes and the lines that introduce them, in reply order: threads by their first message, then by turn, so
that each message follows what it replies to.

A conversation of any length is spread over tasks: originals are pre-aggregated per conversation and hash, threads are found by pointer jumping
(as many rounds as the logarithm of the longest chain), and places come from a range sort with counts per partition.

Defined results: one row for each message. NULL texts are empty. Messages that quote nothing known have no parent and are
threads of their own. Turns that repeat in a conversation are one original; both rows stay, the place of equal ones being by role and text. NULL
conv_id is a conversation of its own; a NULL turn comes first and is no original. Texts of any length and any depth of quotes are read whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.llm.common import map_arrow, stored, texts, type_of

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_INTRODUCTION = re.compile(r"(?:on\b.*\bwrote|.*\b(?:wrote|writes|said|schrieb|escribió|a écrit))\s*:\s*$", re.I)
_OTHER = re.compile(r"[\W_]+")


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines without marks) of neighbouring lines of one level; empty lines end a passage of level 0."""
    found: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks[1].count(">") if marks else 0
        rest = line[marks.end() :] if marks else line
        if found and found[-1][0] == level:
            found[-1][1].append(rest)
        else:
            found.append((level, [rest]))
    return found


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def own_text(parts: list[tuple[int, list[str]]]) -> str:
    """What the message says itself, without lines that introduce a quote."""
    kept = []
    for i, (level, lines) in enumerate(parts):
        if level:
            continue
        lines = list(lines)
        if i + 1 < len(parts):
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and _INTRODUCTION.match(lines[-1].strip()):
                lines.pop()
        kept += lines
    return "\n".join(kept).strip()


def units(lines: list[str]) -> dict[int, int]:
    """Hash and number of words of a passage, of its paragraphs and of its lines."""
    whole = [" ".join(lines), *lines]
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        elif paragraph:
            whole.append(" ".join(paragraph))
            paragraph = []
    found = {}
    for text in whole:
        key = normal(text)
        if key:
            found[xxhash.xxh64_intdigest(key) - (1 << 63)] = key.count(" ") + 1
    return found


def parsed(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text (own), quoted (structs level, hash, words), own (hashes) of each message."""
    source = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    source = source.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "*")

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        own, quoted, said = [], [], []
        for raw in texts(piece):
            parts = passages(raw.decode())
            own.append(own_text(parts))
            quoted.append([{"level": level, "hash": h, "words": n} for level, lines in parts if level for h, n in units(lines).items()])
            said.append([*units(own[-1].split("\n"))])
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [*(piece.column(c) for c in ("conv", "conv_id", "turn", "role")), pa.array(own, pa.string()), pa.array(quoted, quote), pa.array(said, pa.list_(pa.int64()))],
            ["conv", "conv_id", "turn", "role", "text", "quoted", "own"],
        )

    kinds = f"conv string, conv_id {type_of(messages, 'conv_id')}, turn long, role string, text string, quoted array<struct<level:int,hash:long,words:int>>, own array<long>"
    return map_arrow(source, make, kinds)


def links(rows: DataFrame) -> DataFrame:
    """conv, turn, level, original (turn), words: what each message quotes of which earlier message; rows: from parsed()."""
    quotes = rows.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*")
    wanted = quotes.select("conv", "hash").distinct()
    said = rows.filter("turn is not null").select("conv", "turn", F.explode("own").alias("hash"))
    first = stored(said.join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("original")), "originals")
    found = quotes.join(first, ["conv", "hash"]).filter("original < turn")
    return found.groupBy("conv", "turn", "level", "original").agg(F.max("words").alias("words"), F.count_distinct("hash").alias("passages"))


def threads(found: DataFrame) -> DataFrame:
    """conv, turn, parent, thread, depth of the messages that reply to another one; found: from links()."""
    best = F.max(F.struct((-F.col("level")).alias("nearest"), "words", "passages", "original")).alias("best")
    replies = stored(found.groupBy("conv", "turn").agg(best).select("conv", "turn", F.col("best.original").alias("parent")), "replies")
    now = stored(replies.select("*", F.col("parent").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        ahead = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        moved = now.join(ahead, ["conv", "thread"], "left")
        if moved.filter("further is not null").isEmpty():
            return now
        now = stored(moved.select("conv", "turn", "parent", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, parent_turn, thread_turn, depth, quoted_passages, links (level, original turn, words) of each message, in reply order within a conversation."""
    rows = stored(parsed(messages), "messages")
    found = stored(links(rows), "links")
    # As many links as a message has quotes of different originals and levels.
    every = found.groupBy("conv", "turn").agg(F.array_sort(F.collect_list(F.struct("level", "original", "words"))).alias("links"))
    linked = threads(found).select("conv", "turn", "parent", "thread", "depth").join(every, ["conv", "turn"])
    rows = rows.select("conv", "conv_id", "turn", "role", "text", F.size("quoted").alias("quoted_passages")).join(linked, ["conv", "turn"], "left")
    rows = rows.withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    order = ("conv", "thread", "turn", "role", "text")
    ordered = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered-messages")
    part, row = F.shiftright("at", 33), F.col("at") - F.shiftleft(F.shiftright("at", 33), 33)
    # Rows of each conversation in each partition: one row for both, however long a conversation is.
    shares = ordered.groupBy("conv", part.alias("part")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = stored(shares.select("conv", "part", (before - F.col("first")).alias("shift")), "shares")
    placed = ordered.withColumn("part", part).join(shares, ["conv", "part"]).withColumn("place", row + F.col("shift"))
    return placed.select("conv_id", "place", "turn", "role", "text", F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"), "depth", "quoted_passages", F.coalesce("links", F.array().cast("array<struct<level:int,original:bigint,words:int>>")).alias("links"))
