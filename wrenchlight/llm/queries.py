"""One query for each operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenchlight.llm import decontaminate, fertility, html_crf, licenses, line_dedup, mixing, periodic_runs, pii, quotations, scaled_sketch, simhash, substring_dedup, whitening
from wrenchlight.llm.common import keyed, read
from wrenchlight.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(prepare(spark), folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", "factors")


def op2_html_crf(spark: SparkSession, folder: str) -> DataFrame:
    return html_crf.main_texts(read(prepare(spark), folder, "pages"), read(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(keyed(read(prepare(spark), folder, "documents")), read(spark, folder, "benchmark"))
    return found.drop("text_key")


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(prepare(spark), folder, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Written out here and read from the files, apart from the code under test.
_SPELLED = (
    "licence=license|sub license=sublicense|non commercial=noncommercial|organisation=organization|merchantibility=merchantability|favour=favor|whilst=while|per cent=percent|"
    "copyright holder=copyright owner|analogue=analog|fulfil =fulfill |wilful=willful|acknowledgement=acknowledgment|https=http|initialise=initialize|recognise=recognize"
)
_BEGIN_SQL = "'(?im)^[ \\t*#/;.-]*(?:copyright\\b|\\(c\\)|©)'"
_MARKED_SQL = "'(?im)^[ \\t*#/;.-]*(copyright[ \\t]*(\\(c\\)|©|[0-9]{4}|<year>|\\[year\\]|\\[yyyy\\])|\\(c\\)[ \\t]*(copyright|[0-9]{4})|©)[^\\n]*$'"
_RESERVED_SQL = "'(?im)^[ \\t*#/;.-]*all[ \\t]+rights[ \\t]+reserved[ \\t.]*$'"


def _words_sql(text: str) -> str:
    text = f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pair in _SPELLED.split("|"):
        text = "replace({}, {}, {})".format(text, *map(_quoted, pair.split("=")))
    return text


def _unmarked_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {_MARKED_SQL}, '', 'g'), {_RESERVED_SQL}, '', 'g')"


def _digest_sql(text: str) -> str:
    """SHA-256 of the canonical text; ``known`` is a table of one row with the words of all known texts."""
    lines = f"list_filter(string_split({_unmarked_sql(text)}, chr(10)), lambda l: NOT (regexp_matches(l, {_BEGIN_SQL}) AND NOT contains(known.words, ' ' || {_words_sql('l')} || ' ')))"
    return f"sha256({_words_sql(f'array_to_string({lines}, chr(10))')})"


_NOTICE_ROWS = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.NOTICES.items())

OP4_SQL = f"""
WITH files AS (SELECT regexp_extract(filename, '([^/]*)[.]txt$', 1) AS license, content FROM read_text('{licenses.FOLDER}/*.txt')),
one_line AS (SELECT * FROM (VALUES {_NOTICE_ROWS}) AS v(license, content)),
known AS (SELECT ' | ' || string_agg({_words_sql(_unmarked_sql('content'))}, ' | ') || ' | ' AS words FROM (FROM files UNION ALL FROM one_line)),
texts AS (SELECT license, {_digest_sql('content')} AS digest FROM files, known),
notices AS (SELECT license, {_digest_sql('content')} AS digest FROM one_line, known),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
found AS (
  SELECT doc_id, license, CAST(NULL AS VARCHAR) AS notice, CAST(NULL AS BIGINT) AS line
  FROM (SELECT doc_id, {_digest_sql('text')} AS digest FROM documents, known WHERE regexp_matches(text, '(?i)licen|software')) JOIN texts USING (digest)
  UNION ALL
  SELECT doc_id, NULL, license, line
  FROM (SELECT doc_id, line, {_digest_sql('part')} AS digest FROM lines, known WHERE regexp_matches(part, '(?i)licen|software')) JOIN notices USING (digest))
SELECT doc_id, max(license) AS license,
       coalesce(string_agg(DISTINCT notice, ',' ORDER BY notice), '') AS notices, count(DISTINCT line) AS n_notices
FROM found GROUP BY doc_id
"""


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.taken_by_schedule(read(prepare(spark), folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(3 * source_size) OVER o AS caps, sum(weight) OVER o AS full_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM sources WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT source_size, weight, CAST(total - coalesce(caps, 0) AS DOUBLE) / (all_weight - coalesce(full_weight, 0)) AS level FROM ordered),
chosen AS (SELECT max(level) AS level FROM levels),
goals AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM sources, chosen),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) - d.size AS place
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
counted AS (
  SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE
    CAST(place + size / 2.0 < target AS INTEGER) + CAST(place + source_size + size / 2.0 < target AS INTEGER)
    + CAST(place + 2 * source_size + size / 2.0 < target AS INTEGER) END AS INTEGER) AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""


def op6_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.conversations(read(prepare(spark), folder, "conversations"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.remove_lines(read(prepare(spark), folder, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", "text")


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, pos_line, line,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos_line) - 1 AS pos,
         len(string_split_regex(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos_line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (
  SELECT a.doc_id, a.pos, s.size, string_agg(b.line, chr(10) ORDER BY b.pos) AS run, sum(b.words) AS words
  FROM lines a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) s
  JOIN lines b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + s.size - 1
  GROUP BY a.doc_id, a.pos, s.size HAVING count(*) = s.size),
later AS (
  SELECT doc_id, pos, size FROM (
    SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, pos) AS copy FROM runs WHERE words >= 5)
  WHERE copy > 1),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos_line FROM later r
  JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.pos + r.size - 1),
every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos_line FROM documents)
SELECT e.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed,
       coalesce(string_agg(e.line, chr(10) ORDER BY e.pos_line) FILTER (WHERE g.doc_id IS NULL), '') AS text
FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos_line = e.pos_line
GROUP BY e.doc_id
"""


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(read(prepare(spark), folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(prepare(spark), folder, "documents"))


def op10_fertility(spark: SparkSession, folder: str) -> DataFrame:
    found = fertility.judged(read(prepare(spark), folder, "documents"))
    return found.drop("text_key", "n_tokens")


def op11_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return scaled_sketch.fingerprints(read(prepare(spark), folder, "documents"))


OP11_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
followed AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM texts WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (
  SELECT doc_id, n_chars, text, next_text, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM followed),
versions AS (
  SELECT doc_id, 'a' AS which, text FROM edits UNION ALL SELECT doc_id, 'b', edited FROM edits UNION ALL SELECT doc_id, 'c', next_text FROM edits),
words AS (
  SELECT doc_id, which, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT doc_id, which, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM versions)),
shingles AS (
  SELECT doc_id, which, n, i, left(md5(concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w)), 16) AS hash
  FROM words WINDOW w AS (PARTITION BY doc_id, which ORDER BY i)),
hashes AS (
  SELECT doc_id, which, hash, min(hash) OVER (PARTITION BY doc_id, which) AS least FROM shingles WHERE i = 1 OR i <= n - 4),
kept AS (SELECT DISTINCT doc_id, which, hash FROM hashes WHERE hash < '4000000000000000' OR hash = least),
prints AS (
  SELECT v.doc_id, v.which, coalesce(string_agg(k.hash, '' ORDER BY k.hash), '') AS print, count(k.hash) AS size
  FROM versions v LEFT JOIN kept k ON k.doc_id = v.doc_id AND k.which = v.which GROUP BY v.doc_id, v.which),
shared AS (
  SELECT a.doc_id, b.which, count(*) AS both FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.hash = b.hash
  WHERE a.which = 'a' AND b.which <> 'a' GROUP BY a.doc_id, b.which)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
       CASE WHEN a.size + b.size = 0 THEN 1.0 ELSE CAST(coalesce(x.both, 0) AS DOUBLE) / (a.size + b.size - coalesce(x.both, 0)) END AS near_edited,
       CASE WHEN a.size + c.size = 0 THEN 1.0 ELSE CAST(coalesce(y.both, 0) AS DOUBLE) / (a.size + c.size - coalesce(y.both, 0)) END AS near_next,
       CASE WHEN a.size = 0 THEN 1.0 ELSE CAST(coalesce(x.both, 0) AS DOUBLE) / a.size END AS in_edited,
       CASE WHEN a.size = 0 THEN 1.0 ELSE CAST(coalesce(y.both, 0) AS DOUBLE) / a.size END AS in_next
FROM edits e
JOIN prints a ON a.doc_id = e.doc_id AND a.which = 'a'
JOIN prints b ON b.doc_id = e.doc_id AND b.which = 'b'
JOIN prints c ON c.doc_id = e.doc_id AND c.which = 'c'
LEFT JOIN shared x ON x.doc_id = e.doc_id AND x.which = 'b'
LEFT JOIN shared y ON y.doc_id = e.doc_id AND y.which = 'c'
"""


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(prepare(spark), folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(read(prepare(spark), folder, "documents"), periodic_runs.spread_period)
    return found.drop("text", "runs")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_html_crf, op3_decontamination, op4_licenses, op5_mixing,
        op6_quotations, op7_line_dedup, op8_pii, op9_simhash, op10_fertility,
        op11_scaled_sketch, op12_whitening, op13_periodic_runs,
    )
}
SQL: dict[str, str] = {"op4_licenses": OP4_SQL, "op5_mixing": OP5_SQL, "op7_line_dedup": OP7_SQL, "op11_scaled_sketch": OP11_SQL}
