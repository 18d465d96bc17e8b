"""License scans by canonical digest lookup, in built-in functions only.

A text is made canonical: copyright lines go, letters become lower case, equivalent spellings become one, everything but letters and digits
becomes one space. A copyright line begins with copyright, (c) or the sign; if no year, mark or placeholder follows, it goes only where its words stand in no known text, so
that a licence's own sentences stay wherever its lines are broken. The SHA-256 of the whole canonical text is joined with the digests of known licences; in the same way each
line is joined with those of known one-line notices. The known texts are a fixed list, so their table is broadcast, and the scan
needs no shuffle of texts. Texts without any word that all known texts have at least one of are left out early, which loses nothing.

Defined results: one row for each document with a licence or notice. NULL and empty texts have none. Repeated rows with equal doc_id and text
give one row. NULL doc_ids are kept. Texts of any length are made canonical whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlight.llm.common import KEY, keyed
from wrenchlight.llm.license_texts import FOLDER, NOTICES, TEXTS

# Spellings that count as equal, as (pattern, replacement) on lower-case words separated by one space.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("whilst", "while"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("analogue", "analog"), ("fulfil ", "fulfill "), ("wilful", "willful"),
    ("acknowledgement", "acknowledgment"), ("https", "http"), ("initialise", "initialize"), ("recognise", "recognize"),
)
COPYRIGHT_LINE = r"(?im)^[ \t*#/;.-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*$"
NAMED_LINE = r"(?i)^[ \t*#/;.-]*(?:copyright\b|\(c\)|©)"
RESERVED_LINE = r"(?im)^[ \t*#/;.-]*all[ \t]+rights[ \t]+reserved[ \t.]*$"
__all__ = ["FOLDER", "NOTICES", "TEXTS", "scan"]
# Every known text has one of these.
ANCHOR = r"(?i)licen|software"


def _words(text: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    for found, instead in SPELLINGS:
        text = F.replace(text, F.lit(found), F.lit(instead))
    return text


def _without_marked_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), RESERVED_LINE, "")


def known_words(spark: SparkSession, known: dict[str, str]) -> str:
    """The words of all known texts, a fixed list."""
    rows = spark.createDataFrame([*known.items()], "license string, known_text string")
    return " | ".join(["", *(r[0] for r in rows.select(_words(_without_marked_lines(F.col("known_text")))).collect()), ""])


def canonical(text: Column, known: str) -> Column:
    """known: from known_words()."""
    text = _without_marked_lines(text)
    named = lambda line: line.rlike(NAMED_LINE) & ~F.contains(F.lit(known), F.concat(F.lit(" "), _words(line), F.lit(" ")))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~named(line)), "\n")
    return _words(F.when(text.rlike(f"(?m){NAMED_LINE}"), kept).otherwise(text))


def digest(text: Column, known: str) -> Column:
    return F.sha2(canonical(text, known), 256)


def known_digests(spark: SparkSession, texts: dict[str, str], known: str | None = None) -> DataFrame:
    """license, digest of a fixed list of texts."""
    rows = spark.createDataFrame([*texts.items()], "license string, known_text string")
    return F.broadcast(rows.select("license", digest(F.col("known_text"), known_words(spark, texts) if known is None else known).alias("digest")))


def scan(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, license (of the whole text, or NULL), notices (of its lines: names in order, comma-joined), n_notices."""
    spark = docs.sparkSession
    known = known_words(spark, {**{f"text {k}": v for k, v in texts.items()}, **{f"notice {k}": v for k, v in notices.items()}})
    some = keyed(docs).filter(F.col("text").rlike(ANCHOR))
    whole = some.select(*KEY, digest(F.col("text"), known).alias("digest")).join(known_digests(spark, texts, known), "digest")
    lines = some.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line", "part")).filter(F.col("part").rlike(ANCHOR))
    found = lines.select(*KEY, "line", digest(F.col("part"), known).alias("digest")).join(known_digests(spark, notices, known), "digest")
    both = whole.select(*KEY, "license", F.lit(None).cast("string").alias("notice"), F.lit(None).cast("int").alias("line")).union(
        found.select(*KEY, F.lit(None).cast("string"), F.col("license"), "line")
    )
    rows = both.groupBy(*KEY).agg(F.max("license").alias("license"), F.sort_array(F.collect_set("notice")).alias("names"), F.count_distinct("line").alias("n_notices"))
    return rows.select("doc_id", "license", F.concat_ws(",", "names").alias("notices"), "n_notices")
