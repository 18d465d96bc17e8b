"""Each operator against a plain version, on the given documents at the smallest scale and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.llm import plain
from tests.llm.conftest import ODD
from tools.check import compare, connect
from wrenchlight.llm import arrays, decontaminate, fertility, html_crf, licenses, line_dedup, mixing, page_layouts, pii, quotations, simhash, substring_dedup
from wrenchlight.llm.common import components, keyed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("name", ["op4_licenses", "op5_mixing", "op7_line_dedup", "op11_scaled_sketch"])
def test_query_matches_sql(spark, name):
    good, note = compare(spark, connect(SF_SMALL), SF_SMALL, name)
    assert good, note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n)) == list(range(1, 14))


# 1: substring dedup


def test_repeats_of_documents(small):
    rows = small.select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(small).collect()}
    assert found == dict(zip((r.doc_id for r in rows), plain.without_windows([r.text for r in rows])))


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (6, 2)])
def test_repeats_of_odd_rows(odd, empty, window, gram):
    found = [(r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(odd, window, gram).collect()]
    assert sorted(found) == sorted(plain.without_windows([r[1] for r in ODD], window))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_across_boundaries(spark):
    """Pieces of a few sources put together at random: factors end at every place of a block."""
    dice = random.Random(5)
    sources = [[f"{s}w{dice.randrange(9)}" for _ in range(60)] for s in range(4)]
    texts = [" ".join(w for _ in range(4) for s in [dice.choice(sources)] for a in [dice.randrange(50)] for w in s[a : a + dice.randrange(5, 40)]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 12, 4).collect()}
    assert found == dict(enumerate(plain.without_windows(texts, 12)))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_trick_polynomial_hashes(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the base."""
    for n in (64, 200, 1024, 4096):
        one, other = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
        data, offsets = arrays.buffer_of(pa.array([one, other, one]))
        a, b, c = arrays.word_hashes(data, offsets[:-1], offsets[1:])
        assert a == c != b
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{thue_morse(1024)} {rest[:100]}"), (2, f"{other[:1024]} {rest[:100]}")], "doc_id long, text string")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 6, 2).collect()}
    assert found == dict(zip((1, 2), plain.without_windows(texts, 6)))


def test_word_hashes_differ_at_every_byte():
    dice = np.random.default_rng(7)
    words = [bytes(dice.integers(33, 127, n, dtype=np.uint8)) for n in (1, 3, 7, 8, 9, 15, 16, 17, 31, 255, 256, 257, 300) for _ in range(3)]
    words += [w[:i] + bytes([w[i] ^ 1]) + w[i + 1 :] for w in words for i in range(len(w))]
    words += [w + b"\0" for w in words[:39]]
    data, offsets = arrays.buffer_of(pa.array(words, pa.binary()))
    found = arrays.word_hashes(data, offsets[:-1], offsets[1:])
    assert len(set(found.tolist())) == len(set(words))


# 2: main text


def test_main_text_of_held_out_pages(spark):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    weights = html_crf.fit(pages, docs, 60)
    learnt = {r.html for r in html_crf.labelled(pages, docs, 60).collect()}
    text = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    raw = {r.page_id: r for r in pages.collect()}
    right = total = 0
    for r in html_crf.extract(pages, weights).collect():
        page = raw[r.page_id]
        if page.html in learnt:
            continue
        number = int(re.search(r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", page.url)[1])
        title = re.search("<h1>(.*?)</h1>", page.html, re.S)
        total += 1
        # The heading, then the whole document.
        right += r.text.endswith(text[number]) and len(r.text) <= len(text[number]) + len(title[1]) + 1
    assert total > 100 and right >= 0.99 * total


PAGE = """<html><head><title>Site</title><style>p{}</style></head><body class="has-sidebar"><header><nav><ul><li><a href=/>Home<li><a href=/n>News</ul></nav></header>
<div id="cookie-notice"><p>We use cookies here, please accept all of them now.</p><button>OK</button></div>
<main><h1>Great &amp; good</h1><p>First   paragraph with a <a href=#>link</a>, long enough
to count.<p>Second &lt;one&gt;.</p><aside><p>Related: another story, with commas, long enough to look real.</p></aside>
<div class="ad">Buy now, the best thing ever, only today, only for you.</div><p>The last paragraph ends the article.</p>
<section class="comments"><h2>Comments</h2><p>I liked this story very much, thanks for writing it.</p></section></main>
<form><p>Subscribe to our newsletter, it is free and very good.</p></form><footer><p>All rights reserved, Example Company, worldwide.</p></footer>
<script>document.write("<p>no</p>")"""


def test_main_text_of_unseen_structures(spark):
    pages = spark.createDataFrame([(1, "http://x/1", PAGE), (2, None, None), (None, "http://x/2", ""), (4, "u", "<p"), (5, "u", "<!-- <p>never closed"), (6, "u", "&#128512; plain")], "page_id long, url string, html string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_crf.extract(pages, html_crf.fit(given, docs, 60)).collect()}
    assert found[1].text == "Great & good First paragraph with a link, long enough to count. Second <one>. The last paragraph ends the article."
    assert [found[k].text for k in (2, None, 5)] == ["", "", ""] and len(found) == 6
    assert found[1].n_chars == len(found[1].text)


def test_main_text_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://x/none", PAGE)], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert "First paragraph" in html_crf.main_texts(pages, docs).first().text
    assert html_crf.main_texts(pages.filter("false"), docs).count() == 0


def extracted(page, weights):
    found = html_crf.blocks(page)
    return " ".join(b for (b, _), y in zip(found, html_crf.viterbi([f for _, f in found], weights)) if y)


@pytest.fixture(scope="module")
def page_weights(spark):
    return html_crf.fit(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents")))


STORY = "<p>First part of the story, long enough to look real, with commas.</p><p>Second part of it goes on here.</p>"
STORY_TEXT = "First part of the story, long enough to look real, with commas. Second part of it goes on here."


@pytest.mark.parametrize(
    ("article", "more"),
    [
        ('<div class="post-content widget">%s</div>', ""), ('<article class="post tags">%s</article>', ""), ('<div id="story">%s</div>', ""),
        ('<article class="social">%s</article>', ""), ("<main><section class='entry note'>%s</section></main>", ""),
        ('<article>%s<div class="note"><p>A note in the article, which belongs to it.</p></div></article>', " A note in the article, which belongs to it."),
        ('<article>%s<section class="kommentare"><h2>Kommentare</h2><p>Sehr schöner Text, danke dafür, ich habe viel gelernt.</p></section></article>', ""),
        ('<div class="entry">%s<div class="newsletter-box"><p>Subscribe to our weekly letter, it is free.</p></div></div>', ""),
    ],
)
def test_names_of_containers_do_not_decide_alone(page_weights, article, more):
    page = f'<body><nav><a href=/>Home</a><a href=/n>News</a></nav>{article % STORY}<aside class="related"><h3>Related</h3><p>Another story, with commas, that looks real.</p></aside><footer>All rights reserved</footer>'
    assert extracted(page, page_weights) == STORY_TEXT + more


def test_main_text_of_layouts_kept_out_of_training(spark, page_weights):
    """F1 by characters on made-up layouts drawn anew, from documents of another scale."""
    right = wrong = missed = 0
    for n, r in enumerate(spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("text is not null").limit(200).collect()):
        inside = [x for x in r.text.split("\n") if x.strip()] or ["x"]
        found = html_crf.blocks(page_layouts.layout(inside, ["Home", "About", "© site", "We use cookies here, accept them."], random.Random(f"test {n}")))
        for (b, _), y in zip(found, html_crf.viterbi([f for _, f in found], page_weights)):
            wanted = b.startswith(page_layouts.MARK)
            right, wrong, missed = right + len(b) * (wanted and y), wrong + len(b) * (y and not wanted), missed + len(b) * (wanted and not y)
    assert 2 * right / (2 * right + wrong + missed) > 0.93


def test_unclosed_marks_give_no_markup(page_weights):
    for page, wanted in (
        ('<article><p><a href="x>link</a> some text here, long enough to be kept.</p></article>', "link some text here, long enough to be kept."),
        ("<article><p title='it's>Some text here, long enough to be kept.</p></article>", "Some text here, long enough to be kept."),
        ("<article><p>Some text here, long enough to be kept.</p><a href='", "Some text here, long enough to be kept."),
        ("<article><p>Some text < 5 here & long, enough to be kept.</p><!-- <p>no", "Some text < 5 here & long, enough to be kept."),
        ("<article><p>Some text, long enough to be kept.<script>var a='<p>';</script></p><style>p", "Some text, long enough to be kept."),
    ):
        assert extracted(page, page_weights) == wanted


@pytest.mark.parametrize("part", ["<div>", '<a href="', "<a ", "<p>x", "<b>", "<!-- ", "<script>", "<p title='a\">", "&amp; ", "< ", "<li><ul>", "</p>"])
def test_long_pages_take_time_in_proportion(page_weights, part):
    """A megabyte of one thing, then as much of paragraphs in it, takes seconds at most."""
    start = time.process_time()
    extracted(part * (1_000_000 // len(part)), page_weights)
    extracted(part * (250_000 // len(part)) + "<p>x" * 60_000, page_weights)
    assert time.process_time() - start < 25


def test_viterbi_against_all_label_sequences():
    dice = random.Random(8)
    for _ in range(60):
        weights = np.array([dice.gauss(0, 2) for _ in range(html_crf.WIDTH + 4)])
        features = [[dice.randrange(html_crf.WIDTH) for _ in range(3)] for _ in range(dice.randrange(1, 9))]
        t = weights[html_crf.WIDTH :].reshape(2, 2)

        def score(labels):
            return sum(weights[f].sum() for f, y in zip(features, labels) if y) + sum(t[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(features)), key=score)
        assert math.isclose(score(html_crf.viterbi(features, weights)), score(best))


def test_training_finds_the_gradient_of_all_label_sequences():
    """After many steps the expected counts under all label sequences equal the seen ones but for the prior's pull."""
    dice = random.Random(3)
    pages = [([[0, 1 + dice.randrange(6)] for _ in range(5)], np.array([dice.randrange(2) for _ in range(5)])) for _ in range(12)]
    weights = html_crf.train(pages, steps=3000, rate=0.01)
    t, pull = weights[html_crf.WIDTH :].reshape(2, 2), np.zeros(html_crf.WIDTH + 4)
    for features, seen in pages:
        sequences = list(itertools.product((0, 1), repeat=5))
        scores = np.array([sum(weights[f].sum() for f, y in zip(features, s) if y) + sum(t[a, b] for a, b in zip(s, s[1:])) for s in sequences])
        for s, p in [(seen, -1.0), *zip(sequences, np.exp(scores - np.logaddexp.reduce(scores)))]:
            for f, y in zip(features, s):
                np.add.at(pull, f, p * y)
            for a, b in zip(s, s[1:]):
                pull[html_crf.WIDTH + 2 * a + b] += p
    assert np.abs(pull + weights).max() < 0.02


def test_main_text_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x/7", PAGE, "a", "b", "c", 1)], "page_id long, url string, html string, text string, document string, weights string, doc long")
    docs = spark.createDataFrame([(7, "Great & good\nFirst paragraph", "a", "b")], "doc_id long, text string, html string, page_id string")
    assert html_crf.main_texts(pages, docs).columns == ["page_id", "url", "text", "n_chars", "n_blocks"]
    assert html_crf.main_texts(pages, docs).count() == 1


# 3: decontamination


def test_leaks_of_documents(spark, small):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(keyed(small), items).collect()}
    assert found == plain.leaks({r.doc_id: r.text for r in small.collect()}, {r.item_id: r.text for r in items.collect()})
    assert found


def test_leaks_with_other_values(spark, odd, empty):
    item = "If Mary Jones buys 5 apples for 1.25 euros, how much does Mary Jones pay for 10 apples in total today?"
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "too short", "x"), (None, item, "x")], "item_id long, text string, hash string")
    docs = spark.createDataFrame(
        [
            (1, "Well. If Alice Smith buys 12 apples for 3.50 dollars, how much does Alice Smith pay for 24 apples in total today? Yes."),
            (2, "If Alice Smith buys 12 apples for 3.50 dollars, how much does Bob pay for 24 apples in total today?"),
            (3, "Alice pays for her apples every day and has no idea how much she pays in total."),
            (None, item), (5, None),
        ], "doc_id long, text string",
    )
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(keyed(docs), items).collect()}
    assert set(found) == {(1, 7), (1, None), (None, 7), (None, None)}
    assert found[1, 7].n_changed == 5 and found[None, 7].n_changed == 0
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3, 5]
    assert decontaminate.without_leaks(odd, items).count() == len(ODD)
    assert decontaminate.leaks(keyed(empty), items).count() == 0
    assert decontaminate.leaks(keyed(docs), items.filter("false")).count() == 0


NATALIA = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May."
STEPS = "A farmer has 12 red hens and 7 white ones, sells 5 of them at the market, and then buys 20 more for the winter. How many hens are there now?"
GERMAN = "Der Bauer hat 12 Hühner und 7 Enten, verkauft davon 5 auf dem Markt und kauft im Herbst 20 neue Tiere. Wie viele Tiere hat er jetzt?"
RUSSIAN = "Сегодня утром Анна купила 12 яблок и 7 груш, потом отдала Ивану 5 яблок и съела 2 груши. Сколько фруктов осталось?"


def test_leaks_with_other_names_words_and_scripts(spark):
    items = spark.createDataFrame([(1, NATALIA), (2, STEPS), (3, GERMAN), (4, RUSSIAN)], "item_id long, text string")
    words = STEPS.split()
    docs = {
        1: NATALIA.replace("Natalia", "Maria").replace("48", "31"), 2: "Und nun: " + GERMAN.replace("12", "30").replace("20", "9"), 3: RUSSIAN.replace("Анна", "Ольга").replace("Ивану", "Петру").replace("12", "33"),
        4: "Der Hund lief über die Wiese und der Bauer sah ihm nach, bis die Sonne hinter dem Wald verschwand und die Tiere im Stall waren.",
        5: NATALIA.replace("Natalia then", "Maria then"),  # one name for two
        **{100 + i: " ".join([*words[:i], "really", *words[i:]]) for i in range(1, len(words))}, **{200 + i: " ".join([*words[:i], *words[i + 1 :]]) for i in range(len(words)) if not words[i][0].isdigit()},
    }
    frame = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(keyed(frame), items).collect()}
    assert found == plain.leaks(docs, {r.item_id: r.text for r in items.collect()})
    assert {(1, 1), (2, 3), (3, 4)} <= found and not {d for d, _ in found} & {4, 5}
    assert {d for d, i in found if i == 2} == {d for d in docs if d >= 100}


# 4: licences


def test_licenses(spark, odd, empty):
    mit = licenses.TEXTS["MIT"].replace("MIT License", "The MIT Licence".replace("The ", "")).upper()
    docs = spark.createDataFrame(
        [
            (1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, "some text\n # Released under the MIT licence!\nmore"),
            (3, licenses.TEXTS["ISC"] + " and more"), (4, None), (None, "SPDX-License-Identifier: MIT"), (5, "my driving licence expired"),
        ], "doc_id long, text string",
    )
    found = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan(docs).collect()}
    assert found == {1: ("MIT", "", 0), 2: (None, "MIT", 1), None: (None, "MIT (identifier)", 1)}
    assert licenses.scan(odd).count() == licenses.scan(empty).count() == 0


def test_known_texts_differ_and_have_the_anchor(spark):
    known = {**licenses.TEXTS, **{f"{k} notice": v for k, v in licenses.NOTICES.items()}}
    rows = licenses.known_digests(spark, known).collect()
    assert len({r.digest for r in rows}) == len(known)
    assert all(re.search(licenses.ANCHOR, v) for v in known.values())


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no published licences on this machine")
def test_published_licenses(spark):
    """Whole published files, as they are, in capitals, with other line breaks and behind a copyright line."""
    files = [p for p in sorted(COMMON.iterdir()) if not p.is_symlink()]
    texts = [p.read_text(encoding="utf-8") for p in files]
    joined = [re.sub(r"(?<=[a-z,])\n[ \t]*(?=[a-z])", " ", t) for t in texts]
    rows = [*texts, *(t.upper() for t in texts), *joined, *("Copyright The X Authors\n\n" + t for t in texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    n = len(files)
    assert n >= 10 and [i for i in range(len(rows)) if not found.get(i)] == []
    assert all(found[i] == found[i + n] == found[i + 2 * n] == found[i + 3 * n] for i in range(n)) and len({found[i] for i in range(n)}) == n


def test_copyright_lines_without_a_year(spark):
    text = licenses.TEXTS["MIT"]
    wrapped = text.replace("The above copyright notice", "The above\ncopyright notice").replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS OR\nCOPYRIGHT HOLDERS")
    rows = ["Copyright Joyent, Inc. and other Node contributors.\n" + text, "Copyright The X Authors\n(c) Somebody Else\n© Me\n" + text, wrapped, "Copyright law is hard.\nSo is software."]
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: "MIT"} and wrapped != text


def test_licenses_against_sql_on_odd_texts(spark, tmp_path):
    rows = [(i, change(t)) for i, (t, change) in enumerate((t, c) for t in licenses.TEXTS.values() for c in (str.lower, lambda t: "Copyright Anyone\n" + t, lambda t: t.replace(" ", "  ")))]
    rows += [(1000 + i, f"x\n// {t.upper()}\ny") for i, t in enumerate(licenses.NOTICES.values())] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = sorted(con.execute(entry.oracle_sql()["op4_licenses"]).fetchall())
    assert sorted(tuple(r) for r in licenses.scan(docs).collect()) == wanted
    assert {r[0] for r in rows} - {r[0] for r in wanted} == {5000, 5001}


# 5: mixing


def test_mix_of_odd_rows(odd, empty):
    found = [(r.size, r.source_size, round(r.target, 6)) for r in mixing.mixed(odd).collect()]
    rows = [(i, r[1], r[3]) for i, r in enumerate(ODD)]
    assert sorted(found) == sorted((a, b, round(c, 6)) for a, b, c, _ in plain.mix(rows).values())
    assert mixing.mixed(empty).count() == 0


def test_mix_of_equal_rows(spark):
    """12 sources of 18,000 words, of which six equal rows of 1000 words each without an id; no source misses its target by more than half a document."""
    rows = []
    for k in range(12):
        rows += [(None, "same " * 1000, f"s{k:02}")] * 6
        rows += [(1000 * k + i, f"w{k} " * 1000, f"s{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, target = {}, {}
    for r in mixing.taken_by_schedule(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.size == 1000 and r.taken <= 3000 and r.source_size == 18_000
    assert len(taken) == 12 and all(abs(taken[s] - target[s]) <= 500 for s in taken), (taken, target)
    again = sorted(map(repr, mixing.taken_by_schedule(docs).select("doc_id", "source", "taken").collect()))
    assert again == sorted(map(repr, mixing.taken_by_schedule(docs.repartition(3)).select("doc_id", "source", "taken").collect()))


def test_curriculum(small):
    mix = mixing.mixed(small).collect()
    taken, target, largest = {}, {}, {}
    for r in mix:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], largest[r.source] = r.target, max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    # The first source starts with 1.5 times its share: at a quarter of training it has had 0.25 + 0.5 * (0.25 - 0.0625) of its words.
    first = min(taken)
    early = sum(r.size for r in mix if r.source == first for p in r.positions if p <= 0.25)
    assert abs(early - (0.25 + 0.5 * 0.1875) * target[first]) <= 2 * largest[first]
    placed = [r.position for r in mixing.schedule(mixing.mixed(small)).collect()]
    assert placed == sorted(placed) and len(placed) == sum(r.copies for r in mix)


def test_query_goes_through_the_schedule(spark, monkeypatch):
    written = {}
    store = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, purpose: written.setdefault(purpose, store(df, purpose)))
    found = entry.queries()["op5_mixing"](spark, SF_SMALL).collect()
    copies = written["schedule"].collect()
    assert len(copies) == sum(r.copies for r in found) > 0 and sum(r.size for r in copies) == sum(r.taken for r in found)
    assert any(r.copies == 0 for r in found) and all(r.taken == r.copies * r.size for r in found)


def test_training_order(small, odd, empty):
    mix = mixing.mixed(small).collect()
    order = mixing.training_order(small).collect()
    taken = [r for r in order if r.position is not None]
    assert [r.position for r in taken] == sorted(p for r in mix for p in r.positions) and order[: len(taken)] == taken
    assert {r.doc_id for r in order[len(taken) :]} == {r.doc_id for r in mix if not r.copies}
    summed = mixing.taken_by_schedule(odd)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "copies"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(summed) == rows(mixing.mixed(odd))
    assert all((r.first_position is None) == (r.copies == 0) for r in summed.collect())
    assert mixing.taken_by_schedule(empty).count() == mixing.training_order(empty).count() == 0


# 6: quotations


def test_conversations(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow do I cook rice?"),
        (1, 1, "assistant", "> How do I cook RICE?\n\nUse water.\nBoil it for ten minutes."),
        (1, 2, "user", "On Monday the assistant wrote:\n> Boil it for ten minutes.\nOnly ten?"),
        (1, 3, "user", "new topic"),
        (1, 4, "assistant", ">> Boil it for ten minutes.\n> Only ten?\nYes, ten."),
        (1, 5, "user", "> hello there, my friend.\nHi too"),
        (None, 0, "x", "a"), (None, None, None, None), (2, 0, "user", "> Only ten?\nok"), (2, 0, "user", "> Only ten?\nok"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    found = quotations.conversations(frame).collect()
    one = [(r.place, r.turn, r.parent_turn, r.thread_turn, r.depth, r.text) for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.place)]
    assert one == [
        (0, 0, None, 0, 0, "Hello there my friend.\nHow do I cook rice?"), (1, 1, 0, 0, 1, "Use water.\nBoil it for ten minutes."),
        (2, 2, 1, 0, 2, "Only ten?"), (3, 4, 2, 0, 3, "Yes, ten."), (4, 5, 0, 0, 1, "Hi too"), (5, 3, None, 3, 0, "new topic"),
    ]
    assert [(r.place, r.text, r.depth) for r in found if r.conv_id == 2] == [(0, "ok", 0), (1, "ok", 0)]
    assert sorted(r.place for r in found if r.conv_id is None) == [0, 1]
    assert quotations.conversations(frame.filter("false")).count() == 0


def test_generated_mail_threads(spark):
    """Replies that quote any depth of what went before, whole or trimmed to a line, against comparing texts."""
    dice = random.Random(21)
    sentence = lambda: " ".join(dice.choice("rain sun wind snow hill river stone tree bird road".split()) for _ in range(dice.randrange(3, 7))) + dice.choice(".!?")
    rows, wanted = [], {}
    for conv in range(25):
        messages = {}
        for turn in range(dice.randrange(2, 14)):
            own = "\n".join(sentence() if dice.random() < 0.9 else "" for _ in range(dice.randrange(1, 5)))
            if messages and dice.random() < 0.8:
                quoted = messages[dice.choice([*messages])].split("\n")
                if dice.random() < 0.4:  # trimmed: only some lines, often only nested ones
                    nested = [x for x in quoted if x.startswith(">")]
                    quoted = dice.sample(nested or quoted, 1)
                lead = dice.choice(["On Monday somebody wrote:\n", ""])
                own = lead + "\n".join((">" if x.startswith(">") else "> ") + x for x in quoted) + "\n" + own
            messages[turn] = own
            rows.append((conv, turn, "user", own))
        wanted.update({(conv, t): v for t, v in plain.mail_threads(messages).items()})
    dice.shuffle(rows)
    found = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, {(x.level, x.original) for x in r.links}) for r in found} == wanted
    assert sum(v[0] is not None for v in wanted.values()) > 60 and any(min(level for level, _ in v[3]) > 1 for v in wanted.values() if v[3])
    assert not any(line.startswith(">") for r in found for line in r.text.split("\n"))


def test_trimmed_quotes_and_long_messages(spark):
    rows = [(1, 0, "user", "The river is high today."), (1, 1, "user", "> The river is high today.\nTake the road."), (1, 2, "user", ">> The river is high today.\n> [trimmed]\nFine then.")]
    rows += [(2, 0, "user", "\n".join(f"line number {i}" for i in range(20_000))), (2, 1, "user", "\n".join(f"> line number {i}" for i in range(20_000)) + "\nok"), (2, 2, "user", ">" * 5000 + " deep")]
    found = {(r.conv_id, r.turn): r for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 2].parent_turn == 0 and found[1, 2].thread_turn == 0 and [(x.level, x.original) for x in found[1, 2].links] == [(2, 0)]
    assert found[2, 1].parent_turn == 0 and found[2, 1].text == "ok" and found[2, 2].parent_turn is None


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> this is message number {i - 1}\n" if i else "") + f"this is message number {i}") for i in range(40)]
    found = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.depth, r.thread_turn, r.place) for r in found) == [(i, i, 0, i) for i in range(40)]


# 7: line dedup


def test_lines_of_odd_rows(odd, empty):
    order = sorted({(r[0] is None, r[0] or 0, keep) for r in ODD for keep in [r[1] or ""]})
    left = plain.lines_left({k: k[2] for k in order})
    wanted = sorted((r[0] or 0, left[r[0] is None, r[0] or 0, r[1] or ""] if r[1] is not None else "NULL") for r in ODD)
    found = line_dedup.without_repeated_lines(odd)
    assert found.columns == odd.columns
    assert sorted((r.doc_id or 0, "NULL" if r.text is None else r.text) for r in found.collect()) == wanted
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_lines_of_short_runs(spark):
    """Random runs of short lines, where only several lines together count."""
    dice = random.Random(3)
    docs = {i: "\n".join(dice.choice(["a", "b c", "d e f", "g h i j", "k l m n o", "", " "]) for _ in range(dice.randrange(1, 9))) for i in range(70)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame).collect()} == plain.lines_left(docs)


# 8: personal data


TRICKY = [
    "a@b.c_d@e.f é x@y", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.1.1.00000000000000000000001", "+1 (222) 333-4444 é +12", "a" * 20000, "1" * 9000,
    "4111 1111 1111 1111 2", "x@y.z" * 200, "@@@ a@ @b.c ..a@b..c 日1 a.b@c.d", "+1+2 345 6789 0 +1234567", "4111-1111-1111-1111", "1..2.3.4.5 00.0.0.0 +1.....2",
]


def check_base(found, rows):
    wanted = sorted(
        (tuple(len(v) for v in s.values()), hashlib.sha256(plain.listed(s).encode()).hexdigest(), plain.listed(s)) for s in (plain.base_spans(t) for t in rows)
    )
    assert sorted(((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256, r.spans) for r in found) == wanted


def test_personal_data_of_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(10**6 + i, t) for i, t in enumerate(TRICKY)]
    check_base(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect(), [t for _, t in rows])


def test_personal_data_of_odd_rows(odd, empty):
    check_base(pii.personal_data(odd).collect(), [r[1] for r in ODD])
    assert pii.personal_data(empty).count() == 0


def test_patterns_find_more(spark):
    rows = [(i, f"hello there, call me at +1 (555) 010-{i:04d} today") for i in range(30)]
    rows += [(100, "hello there, call me at 555-010-9999, please"), (101, "something else about 555-010-9999 x"), (102, "please call me at noon"), (103, "call me at 10")]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3].spans == "phone:24:41"
    assert found[100].spans == "phone:24:36" and found[100].n_phone == 0
    assert [found[k].spans for k in (101, 102, 103)] == ["", "", ""]


LOST = [
    (200, "hello there, call me at 555-010-9999\n555-010-8888", "phone:24:36"), (201, "so call me at tel:555-010-9999 x", "phone:18:30"), (202, "call me at a@b.com 555-010-9999", "email:11:18"),
    (203, "oh call me at 555-010-9999\t12", "phone:14:26"), (204, "now call me at +1 (555) 010-0001 555-010-9999 !", "phone:15:32"), (205, "note tel: 555-010-7777.", "phone:10:22"),
    (206, "note tel=555-010-7778, ok", "phone:9:21"),
]


def test_candidates_end_at_lines_tabs_and_marks(spark):
    rows = [(i, f"hello there, call me at +1 (555) 010-{i:04d} today") for i in range(30)] + [(50 + i, f"note tel: +1 (555) 020-{i:04d} is mine") for i in range(30)]
    rows += [r[:2] for r in LOST]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: found[k] for k, _, _ in LOST} == {k: v for k, _, v in LOST}


def test_precision_and_recall_on_planted_identifiers(spark):
    """Unseen identifiers in the contexts of seeds among numbers of the same shape in other contexts, each context being used for one kind of thing."""
    dice = random.Random(11)
    filler = lambda: " ".join(f"w{dice.randrange(400)}" for _ in range(dice.randrange(4, 20)))
    phone = lambda plus: f"{'+1 ' if plus else ''}({dice.randrange(200, 999)}) {dice.randrange(200, 999)}-{dice.randrange(1000, 9999)}"
    card = lambda: " ".join(f"{dice.randrange(1000, 9999)}" for _ in range(4))
    good = {"phone": ["call me at", "my mobile is", "phone number:"], "card": ["pay with card", "charged to visa"], "email": ["write to", "reply to mailbox"]}
    bad = ["order no", "isbn", "tracking code", "build"]
    valid = [c for c in (card() for _ in range(6000)) if plain.luhn(c.replace(" ", ""))]
    docs, wanted = [], {}
    for n in range(1200):
        kind = dice.choice([*good, "bad"])
        if kind == "bad":
            value, context, unseen = dice.choice([phone(False), card(), str(dice.randrange(10**7, 10**12))]), dice.choice(bad), False
        else:
            unseen, context = dice.random() < 0.1, dice.choice(good[kind])
            if kind == "phone":
                value = phone(not unseen)
            elif kind == "card":
                value = next(c for c in iter(card, "") if not plain.luhn(c.replace(" ", ""))) if unseen else dice.choice(valid)
            else:
                value = f"user{n}@{'intranet' if unseen else 'mail.example.com'}"
        text = f"{filler()} {context} "
        start = len(text)
        docs.append((n, f"{text}{value} {filler()}"))
        if unseen:
            wanted[n] = f"{kind}:{start}:{start + len(value)}"
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).filter("n_added > 0").collect()}
    right = sum(found.get(k) == v for k, v in wanted.items())
    assert right >= 0.95 * len(wanted) and right >= 0.95 * len(found), (right, len(wanted), len(found))


def test_texts_of_many_matches(spark):
    text = " ".join(f"name{i}@mail.example.com" for i in range(32_000))
    docs = spark.createDataFrame([(1, text), (2, "1 " * 200_000), (3, "x" * 300_000 + " y " * 1000 + "a@b.cd 4111 1111 1111 1111")], "doc_id long, text string")
    start = time.perf_counter()
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert found[1].n_email == 32_000 and found[1].spans.endswith(f"email:{len(text) - 26}:{len(text)}") and found[3].n_card == 1
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700, 66_000])
def test_running_sums(spark, n):
    sizes = [(i * 7) % 13 for i in range(n)]
    found = spark.createDataFrame([(sizes,)], "a array<int>").select(pii.running(F.col("a")).alias("r")).first().r
    assert found == list(itertools.accumulate(sizes))


def test_long_words_before_a_match_are_whole(spark):
    long = "v" * 300
    rows = [(i, f"so the {long} {long} +1 (555) 010-{i:04d} today") for i in range(8)] + [(9, f"and {long} {long} 555-010-9999 now")]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[9] == "phone:606:618"


# 9: SimHash


def test_near_duplicates_of_documents(small):
    rows = {r.doc_id: plain.fingerprint(r.text) for r in small.collect()}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(small).collect()}
    groups = plain.near_groups(rows)
    assert found == {k: (f"{v:016x}", groups[k]) for k, v in rows.items()}
    assert {r.doc_id for r in simhash.keep_one(small).collect()} == set(groups.values())


def test_near_duplicates_of_odd_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert sorted(r.fingerprint for r in found) == sorted(f"{plain.fingerprint(r[1]):016x}" for r in ODD)
    zero = [r.component_id for r in found if int(r.fingerprint, 16) == 0]
    assert len(zero) == 4 and set(zero) == {2}
    assert simhash.keep_one(odd).columns == odd.columns
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert kept.count(6) == 2 and kept.count(None) == 1 and 3 not in kept
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_links_at_every_distance(spark):
    dice = random.Random(1)
    prints = {dice.getrandbits(64) for _ in range(40)}
    prints |= {p ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64)) for p in prints} | {p ^ 1 for p in prints}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    labels = {r.fp & ((1 << 64) - 1): r.label for r in simhash.labelled(frame, 2).collect()}
    groups = plain.near_groups({p: p for p in prints})
    assert len({(labels[p], groups[p]) for p in prints}) == len(set(labels.values())) == len(set(groups.values()))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=25))
def test_components(spark, pairs):
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.label for r in components(frame).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    assert found == plain.group({n for p in linked for n in p}, linked)


# 10: quality rules


def test_fertility_of_documents(small):
    measures = plain.Measures()
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    found = {r.doc_id: r for r in fertility.judged(small).collect()}
    kept = plain.kept_by_quality(rows, measures)
    for key, text, _ in rows:
        r = found[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.base_counts(text)
        n, values = measures.of(text)
        assert r.n_tokens == n and all(math.isclose(r[m], v, abs_tol=1e-9) for m, v in zip(fertility.MEASURES, values))
    assert {k for k, r in found.items() if r.kept} == kept


def test_fertility_of_odd_rows(odd, empty):
    found = fertility.judged(odd).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted(plain.base_counts(r[1]) for r in ODD)
    assert {r.band_of for r in found} == {"en", "de", "fr", "script latin", "script cyrillic"} | {r.band_of for r in found if r.band_of.startswith("script")}
    assert all(r.base_failed for r in found if r.n_words < 50) and not any(r.kept for r in found if r.base_failed)
    assert fertility.keep_good(odd).columns == odd.columns
    assert fertility.judged(empty).count() == 0


def test_fertility_rejects_other_text(spark):
    dice = random.Random(2)
    common = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()
    rows = [(i, " ".join(dice.choice(common) + str(dice.randrange(10)) for _ in range(150)), "en") for i in range(60)]
    rows.append((100, " ".join("".join(chr(dice.randrange(0x1F300, 0x1F600)) for _ in range(6)) for _ in range(100)), "en"))
    found = {r.doc_id: r for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not found[100].kept and "byte_share" in found[100].reasons and all(found[i].kept for i in range(60))


def test_fertility_rejects_junk_inside_the_language(spark):
    folder = SF_SMALL.replace("sf0.001", "sf0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = {r.doc_id: r for r in fertility.judged(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r.base_failed}
    assert not any(found[k].kept for k in (37, 67, 101))  # every word followed by ***, $$$, %%% or &&&
    kept = {q: [r.kept for k, r in found.items() if quality.get(k) == q] for q in (0, 1)}
    assert sum(kept[0]) <= 0.4 * len(kept[0]) and sum(kept[1]) >= 0.99 * len(kept[1])
