"""Text clean-up, tag predicates and names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes (Spark's trim removes blanks only).
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# The same characters inside a regular expression class. The short form, for texts
# of ASCII characters only, is many times faster to match.
_ASCII_SPACE = r"\s\x1c-\x1f"
_ANY_SPACE = _ASCII_SPACE + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Tags that mark a job as a return visit.
CALLBACK_TAGS = ("callback", "call back", "call-back", "recall", "warranty", "warrantee")

# Fixed value: tag of the DFO jobs.
DFO_TAG = "dfo"

# Words that show a club membership in tags, descriptions or items.
CLUB_KEYWORDS = (
    "wizard club",
    "wizard",
    "club",
    "membership",
    "member",
    "maintenance plan",
    "service plan",
    "agreement",
)

# Words the club audit takes for an installation.
AUDIT_INSTALL_KEYWORDS = ("install", "changeout", "change-out", "replacement", "new system")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def clean(c: Column | str) -> Column:
    """Trimmed lower-case text, '' for NULL."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def or_default(c: Column | str, default: str) -> Column:
    """The trimmed text, or ``default`` where it is NULL or blank."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def any_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


# ---- tags ------------------------------------------------------------------


def _by_alphabet(text: Column, build: Callable[[str], Column]) -> Column:
    """``build`` with the white space class that the text needs."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, build(_ASCII_SPACE)).otherwise(build(_ANY_SPACE))


def normalize_tags(tags: Column | str) -> Column:
    """'A, b,,' -> 'a,b'; NULL -> ''. Repeats are kept.

    Written with string functions only: higher-order array functions would drop
    the stage out of generated code. A run of commas, with white space around and
    between them, becomes one comma (possessive, so in linear time).
    """
    text = F.lower(col(tags))
    joined = _by_alphabet(text, lambda space: F.regexp_replace(text, f"[{space}]*+,[{space},]*+", ","))
    return F.coalesce(F.btrim(joined, F.lit(WHITESPACE + ",")), F.lit(""))


def normalize_tags_distinct(tags: Column | str) -> Column:
    """'A, b, a' -> 'a|b', first-seen order; NULL -> ''."""
    return F.array_join(F.array_distinct(F.split(normalize_tags(tags), ",")), "|")


def has_any_tag(tags: Column | str, needles: Iterable[str]) -> Column:
    """Does the tag text hold any of the needles, whatever the case?

    A needle with a blank inside matches anywhere. Any other one must be a whole
    word between commas, white space or the ends. Blank needles never match.
    """
    wanted = [needle.strip().lower() for needle in needles]
    text = F.coalesce(F.lower(col(tags)), F.lit(""))
    tests = [text.contains(word) for word in wanted if " " in word]
    words = "|".join(re.escape(word) for word in wanted if word and " " not in word)
    if words:
        tests.append(_by_alphabet(text, lambda space: text.rlike(f"(?:^|[{space},])(?:{words})(?:$|[{space},])")))
    return any_of(tests)


def tag_has(tags: Column | str, needle: str) -> Column:
    return has_any_tag(tags, (needle,))


def is_dfo(tags: Column | str) -> Column:
    return tag_has(tags, DFO_TAG)


def is_callback(tags: Column | str) -> Column:
    return has_any_tag(tags, CALLBACK_TAGS)


def contains_any(text: Column | str, keywords: Iterable[str]) -> Column:
    """Is any keyword a substring, whatever the case? NULL text and blank keywords never match.

    Keywords that hold another keyword are left out of the test, as the other one decides.
    """
    words = {word.lower() for word in keywords if word and word.strip()}
    needed = [w for w in sorted(words) if not any(other != w and other in w for other in words)]
    lowered = F.coalesce(F.lower(col(text)), F.lit(""))
    return any_of(lowered.contains(word) for word in needed)


def has_club_word(text: Column | str) -> Column:
    return contains_any(text, CLUB_KEYWORDS)


# ---- names -----------------------------------------------------------------


def full_name(first: Column | str, last: Column | str, first_default: str = "") -> Column:
    """'first last', both trimmed; ``first_default`` stands in for a NULL first name."""
    head = F.coalesce(strip(first), F.lit(first_default))
    tail = F.coalesce(strip(last), F.lit(""))
    return strip(F.concat(head, F.lit(" "), tail))


def customer_name(first: Column | str, last: Column | str) -> Column:
    return full_name(first, last, first_default="Unknown")


def employee_name(first: Column | str, last: Column | str) -> Column:
    return or_default(full_name(first, last), "Unknown")


def looks_like_raw_id(name: Column | str) -> Column:
    """Fixed format: an internal employee id that leaked into a name column."""
    return F.coalesce(col(name).rlike("^pro_[0-9a-f]{32}$"), F.lit(False))
