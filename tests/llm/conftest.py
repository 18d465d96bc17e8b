from __future__ import annotations

import pytest

LONG = " ".join(f"word{i}" for i in range(40))
PASSAGE = " ".join(f"shared{i} passage" for i in range(40))
# NULLs, empty and long texts, white space of several kinds, ties, repeated rows, repeated ids.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b ", "en", None),
    (5, LONG + "\n" + PASSAGE + "\n" + LONG, "en", "b"),
    (6, "x " + PASSAGE + " y", "en", "b"),
    (6, "x " + PASSAGE + " y", "en", "b"),
    (6, "another text under the same id with several words in it", "de", "c"),
    (None, "no id but a text of some words, mail me@here.org", "en", "c"),
    (None, None, None, None),
    (7, "one\ntwo\nthe quick brown fox jumps over the lazy dog\nthree", "fr", "a"),
    (8, "a b\nc d\ne f\ng", "fr", "a"),
    (9, "zz\na b\nc d\ne f\nyy", "fr", "a"),
    (10, "é ü 日本語 текст +1 (555) 123-4567 1.2.3.4 4111 1111 1111 1111", None, "b"),
    (11, "x" * 5000 + " " + "la " * 3000, "en", "b"),
]
CLASHING = "text_key label fp anchor block hash words pos line row gone rank n lang2 kind spans value pattern size target".split()


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with further columns whose names the operators use inside."""
    rows = [(*r, len(r[1] or ""), *(["1"] * len(CLASHING))) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
