"""Personal data by bootstrapped contextual extraction, in built-in functions only.

Seeds are the matches of four fixed patterns (email, ip, card, phone). Candidates are whatever looks like one of them: addresses at any host, four or more numbers with dots, seven to nineteen digits
with few marks between them. They end at line ends, tabs, ``:`` and ``=``, and where a run of digits is too long for a number it is cut at its blanks. A candidate's lexical patterns
are the one and the two words on either side of it, up to the next candidate; marks of quotation, brackets, ``:`` and ``=`` stand between words, so that a label glued to the value is a word.
Patterns and candidates form a bipartite graph over the whole corpus, scored in rounds: a pattern's score for a kind is the sum of its candidates' scores over their
number plus one; a seed scores 1 for its kind, any other candidate the mean of its patterns. Candidates
that are no seeds but stand at a pattern with a high score and enough different seeds (of a single word four times as many), and have the kind's characters, become spans: cards
with a mistyped digit, phones without a plus, addresses at a bare host.

Each text is searched once. Offsets come from cutting it at the matches: lengths of what lies between and of the matches, summed up in blocks, so
that a text of tens of thousands of matches takes time in proportion. Added spans that overlap a base span go; for that the spans of a document are sorted.
Scores come from partial aggregations that are written before they are
joined back, so a pattern like "of the" is spread over tasks.

Defined results: NULL texts are empty. Offsets are code points, ends exclusive. Base matches are leftmost and do not overlap within a kind; matches that fail
their check are dropped without another try. Repeated rows give equal results, and their
candidates count once in scores. Documents are told apart by doc_id (NULL allowed) and text. Texts of any length are searched whole. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlight.llm.common import KEY, keyed, same_key, stored

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive quantifiers and look-behinds find the same matches without going over long runs again and again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]"
_IP = r"(?<![A-Za-z0-9.])[0-9]++(?:\.[0-9]++){3,}+"
_NUMBER = r"(?<![A-Za-z0-9.-])[(+]?[0-9](?:[\x20().-]{0,3}[0-9]){6,18}(?![A-Za-z0-9]|[.()-]+[0-9])"
CANDIDATE = f"{_EMAIL}|{_IP}|{_NUMBER}"
# What stands between words, and what a word is made of.
_GAP = r"[\x20\x09-\x0D:=\"'()\[\]<>]"
_WORD = r"[^\x20\x09-\x0D:=\"'()\[\]<>]"
SHAPES = {
    "email": r"^[^@]+@[^@]*[A-Za-z0-9]$",
    "ip": r"^[0-9]+(?:\.[0-9]+){3,}(?::[0-9]+)?$",
    "card": r"^[0-9](?:[\x20-]*[0-9]){12,18}$",
    "phone": r"^[(+]?[0-9](?:[\x20().-]*[0-9]){7,14}$",
}
SCORE, SEEDS, ROUNDS = 0.8, 5, 3
# How many more seeds a pattern of a single word needs.
SINGLE = 4
_BLOCK = 256
_SPANS = "array<struct<start:int,end:int,text:string>>"
_ADDED = "array<struct<kind:string,start:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column) -> Column:
    """Running sums of an array, by blocks: an array that grows is copied at each step, so only short ones grow."""
    sums = lambda array: F.aggregate(array, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(within: Column) -> Column:
        totals = F.transform(within, lambda w: F.element_at(w, -1))
        # The sums before each block, again by blocks.
        outer = F.transform(F.sequence(F.lit(0), F.floor((F.size(totals) - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(totals, b * _BLOCK + 1, F.lit(_BLOCK))))
        starts = lambda o: sums(F.transform(o, lambda w: F.element_at(w, -1)))
        before = _let(outer, lambda o: _let(starts(o), lambda s: F.flatten(F.transform(o, lambda w, k: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda v: v + F.get(s, k))))))
        return _let(before, lambda s: F.flatten(F.transform(within, lambda w, k: F.transform(F.slice(w, F.lit(2), F.size(w) - 1), lambda v: v + F.get(s, k)))))

    return F.when(F.size(sizes) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """start, end, text of each match, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
        return _let(steps, lambda s: F.zip_with(running(s), found, lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("text"))))

    return F.when(text.rlike(pattern), _let(hits, spans)).otherwise(F.array().cast(_SPANS))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return ~F.exists(plain, lambda p: (F.length(p) > 3) | (F.when(F.length(p) <= 3, F.lpad(p, 4, "0").cast("int")) > 255))
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["text"])


def _of(kind: str) -> Column:
    """The spans of a kind as structs of kind, start, end."""
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (from keyed()) with one array of spans for each kind."""
    for kind in KINDS:
        found = F.filter(matches(F.col("text"), PATTERNS[kind]), _check(kind))
        hint = F.col("text").contains("@") if kind == "email" else F.col("text").rlike("[0-9]")
        docs = docs.withColumn(kind, F.when(hint, found).otherwise(F.array().cast(_SPANS)))
    return docs


def _seed_kind(value: Column) -> Column:
    """The kind of base match that a candidate is, or NULL."""
    whole = {k: rf"^(?:{PATTERNS[k]})$" for k in KINDS}
    return F.coalesce(*(F.when(value.rlike(whole[k]) & _valid(k, value), F.lit(k)) for k in KINDS))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a candidate: its side, number of words and words."""
    before, after = F.lower(before), F.lower(after)
    words = lambda c: F.regexp_replace(c, rf"{_GAP}+", " ")
    found = {
        "<1 ": F.regexp_extract(before, rf"(?<!{_WORD})({_WORD}++){_GAP}*+$", 1), "<2 ": words(F.regexp_extract(before, rf"(?<!{_WORD})({_WORD}++{_GAP}++{_WORD}++){_GAP}*+$", 1)),
        ">1 ": F.regexp_extract(after, rf"^(?:{_GAP}|[.,;!?])*+({_WORD}++)", 1), ">2 ": words(F.regexp_extract(after, rf"^(?:{_GAP}|[.,;!?])*+({_WORD}++{_GAP}++{_WORD}++)", 1)),
    }
    return F.array_compact(F.array(*(F.when(c != "", F.concat(F.lit(k), c)) for k, c in found.items())))


def candidates(text: Column) -> Column:
    """start, end, value, kind (of the seed it is, else NULL) and patterns of every candidate."""

    def described(spans: Column) -> Column:
        between = F.split(text, CANDIDATE, -1)
        return _let(between, lambda b: F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lower(s["text"]).alias("value"), _seed_kind(s["text"]).alias("kind"), _patterns(F.get(b, i), F.get(b, i + 1)).alias("patterns")
        )))

    return _let(matches(text, CANDIDATE), described)


def searched(docs: DataFrame) -> DataFrame:
    """KEY, the number of base matches of each kind, base (their spans), candidates; docs from keyed(). Each text is read once."""
    found = base_spans(docs).withColumn("candidates", F.when(F.col("text").rlike("[0-9@]"), candidates(F.col("text"))))
    return found.select(*KEY, *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*map(_of, KINDS)).alias("base"), "candidates")


def occurrences(found: DataFrame) -> DataFrame:
    """KEY, start, end, value, pattern, kind of every candidate and pattern; found: from searched()."""
    rows = found.select(*KEY, F.explode("candidates").alias("x"))
    return rows.select(*KEY, "x.start", "x.end", "x.value", F.explode("x.patterns").alias("pattern"), "x.kind")


def pattern_scores(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, score, seeds after some rounds over the graph; seen: from occurrences()."""
    known = seen.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = stored(known, "pattern-edges")
    seeds = stored(edges.groupBy("value").agg(F.min("kind").alias("seed"), F.count("*").alias("patterns")), "instances")
    edges = stored(edges.select("pattern", "value").join(seeds, "value"), "graph")
    sizes = stored(edges.groupBy("pattern").agg(F.count("*").alias("instances")), "pattern-sizes")
    mine = F.when(F.col("seed").isNotNull(), F.lit(1.0)).otherwise(0.0)
    scores = stored(edges.select("pattern", "value", F.col("seed").alias("kind"), mine.alias("score"), "seed").filter("kind is not null"), "scores-0")
    for n in range(1, rounds + 1):
        summed = scores.groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count("seed").alias("seeds"))
        patterns = stored(summed.join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("instances") + 1)).alias("score"), "seeds"), f"pattern-scores-{n}")
        if n == rounds:
            return patterns
        # Other instances: the mean over all their patterns.
        other = edges.filter("seed is null").join(patterns.select("pattern", "kind", "score"), "pattern")
        mean = stored(other.groupBy("value", "kind").agg((F.sum("score") / F.max("patterns")).alias("score")), f"instance-scores-{n}")
        unseeded = edges.filter("seed is null").select("pattern", "value").join(mean, "value")
        scores = stored(
            edges.filter("seed is not null").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"), "seed")
            .union(unseeded.select("pattern", "value", "kind", "score", F.lit(None).cast("string").alias("seed"))), f"scores-{n}",
        )
    raise ValueError("rounds must be positive")


def discovered(seen: DataFrame, base: DataFrame, score: float = SCORE, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """KEY, kind, start, end of the candidates that trusted patterns add; base: KEY, base (spans of the fixed patterns)."""
    needed = F.when(F.substring("pattern", 2, 1) == "1", seeds * SINGLE).otherwise(seeds)
    trusted = pattern_scores(seen, rounds).filter((F.col("score") >= score) & (F.col("seeds") >= needed))
    trusted = stored(trusted.groupBy("pattern").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("as")), "trusted-patterns")
    shaped = reduce(lambda a, b: a | b, [(F.col("as.kind") == k) & F.col("value").rlike(SHAPES[k]) for k in KINDS])
    # Also such as would be a base match by themselves, but are part of a longer one that failed its check.
    added = seen.join(trusted, "pattern").filter(shaped)
    added = added.groupBy(*KEY, "start", "end").agg(F.max_by("as.kind", F.struct("as.score", "as.kind")).alias("kind"))
    added = stored(added.withColumn("mine", F.lit(1)), "added")
    # Beside the base spans of the same documents, sorted: what begins before the end of a base span, or lasts into one, goes.
    mine = added.select(*KEY).distinct()
    others = base.join(mine.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"}), (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    others = others.select(*KEY, F.explode("base").alias("s")).select(*KEY, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), F.lit(0).alias("mine")).distinct()
    order = Window.partitionBy(*KEY).orderBy("start", "mine", "end")
    ended = F.max(F.when(F.col("mine") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("mine") == 0, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = others.unionByName(added.select(*KEY, "start", "end", "kind", "mine")).withColumns({"ended": ended, "begins": begins})
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))
    return both.filter((F.col("mine") == 1) & free).select(*KEY, "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    numbers = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(numbers, s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame, score: float = SCORE, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), n_added."""
    found = stored(searched(keyed(docs)), "searched")
    added = discovered(occurrences(found), found.select(*KEY, "base"), score, seeds, rounds).groupBy(*KEY).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    added = stored(added, "added-spans")
    joined = found.drop("candidates").join(added, same_key(found, added), "left")
    more = F.coalesce("added", F.array().cast(_ADDED))
    return joined.select(found["doc_id"], *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_added"))
