"""Threshold-scaled sketches, whitening and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tests.llm.plain import words
from wrenchlight.llm import periodic_runs, scaled_sketch, whitening

# 11: threshold-scaled sketches


def plain_sketch(text, scale=4):
    w = words(text)
    grams = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    every = {hashlib.md5(g.encode()).hexdigest()[:16] for g in grams}
    return {h for h in every if int(h, 16) < 2**64 // scale} or ({min(every)} if every else set())


def plain_prints(rows):
    """(doc_id, n_chars, digest, fingerprints, likenesses) of each row; rows: (doc_id, text)."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    follows = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    out = []
    for i, t in rows:
        t = t or ""
        n, after = len(t), follows[i, t]
        edited = t[: n - n // 3] + after[: n // 3]
        a, b, c = map(plain_sketch, (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), like(a, b), like(a, c)))
    return out


def prints_of(docs):
    return [tuple(r)[:7] for r in scaled_sketch.fingerprints(docs).collect()]


def test_sketches_of_documents(small):
    assert sorted(prints_of(small)) == sorted(plain_prints([(r.doc_id, r.text) for r in small.collect()]))


def test_sketches_of_odd_rows(spark, odd, empty):
    # The two documents with one id come by the hash of their text; leave one out, so that the plain version needs no hash.
    rows = [r for r in ODD if r[0] not in (6, None)] + [r for r in ODD if r[0] == 6][:2] + [ODD[-7]]
    rows = [r for r in rows if r[0] is not None] + [(None, "one without an id", None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("head", F.lit("x")).withColumn("wanted", F.lit("x")).withColumn("place", F.lit("x"))
    assert sorted(map(str, prints_of(docs))) == sorted(map(str, plain_prints([r[:2] for r in rows])))
    assert len(prints_of(odd)) == len(ODD) and prints_of(empty) == []
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    assert prints_of(one) == plain_prints([(1, "a b c d e f g h i")])


def test_sketches_merge_and_estimate(spark):
    dice = random.Random(3)
    long = [f"w{dice.randrange(10**6)}" for _ in range(20_000)]
    part, other = long[7_000:7_600], [f"v{dice.randrange(10**6)}" for _ in range(600)]
    rows = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(part)), (3, " ".join(part[:300] + other[:300])), (4, " ".join(other))], "n int, text string")
    made = rows.select("n", scaled_sketch.sketch(F.col("text")).alias("sketch")).collect()
    a = {r.n: r.sketch for r in made}
    pair = lambda x, y: spark.createDataFrame([(a[x], a[y])], "x array<string>, y array<string>").select(scaled_sketch.containment(F.col("x"), F.col("y")), scaled_sketch.likeness(F.col("x"), F.col("y"))).first()
    assert pair(2, 1)[0] == 1.0 and pair(4, 1)[0] == 0.0 and abs(pair(3, 2)[0] - 0.5) < 0.12
    assert abs(pair(2, 1)[1] - 0.03) < 0.01 and abs(len(a[1]) - 5000) < 300
    both = spark.createDataFrame([("g", a[2]), ("g", a[4])], "g string, sketch array<string>")
    assert sorted(r.hash for r in scaled_sketch.merged(both, "g").collect()) == sorted(set(a[2]) | set(a[4]))
    assert rows.select(scaled_sketch.hashes_of(scaled_sketch.fingerprint(scaled_sketch.sketch(F.col("text")))).alias("s")).first().s == a[1]


# 12: whitening


def plain_whitening(rows):
    """{(row, component): values} by numpy, and n; rows: usable vectors."""
    x = np.floor(np.array(rows, float) * 256)
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    w = (x - fit.mean(0)) @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
    exact = [[int(v) for v in r] for r in x]
    sums = [sum(int(v) for v in column) for column in fit.T]
    return len(fit), w, values[::-1] / values.sum(), [sum((len(fit) * v - s) ** 2 for v, s in zip(r, sums)) for r in exact]


def test_whitening_of_embeddings(spark):
    given_rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    data = given_rows.collect()
    n, w, explained, deviation = plain_whitening([r.embedding for r in data])
    found = {(r.vec_id, r.component): r for r in whitening.whiten(given_rows).collect()}
    assert len(found) == 4 * len(data)
    for k in range(4):
        got = np.array([found[r.vec_id, k + 1].whitened for r in data])
        assert min(abs(got - w[:, k]).max(), abs(got + w[:, k]).max()) < 1e-9
        assert math.isclose(found[data[0].vec_id, k + 1].explained, explained[k], rel_tol=1e-9)
    assert [found[r.vec_id, 1].deviation for r in data] == deviation
    assert all(r.n == n and r.identity_error < 1e-9 for r in found.values())


def test_whitening_of_odd_rows(spark):
    dice = random.Random(2)
    good = [(i, [dice.random(), dice.random() * 3, dice.random() / 2]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, [1.0, 2.0]), (105, []), (None, [0.5, 0.5, 0.25])]
    rows = spark.createDataFrame(good + [good[0]] * 5 + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    found = whitening.whiten(rows).collect()
    used = [r for _, r in good] + [good[0][1]] * 5 + [[0.5, 0.5, 0.25]]
    n, w, explained, deviation = plain_whitening(np.array(used, np.float32))
    assert len(found) == 3 * len(used) and {r.n for r in found} == {n} and n <= 31 and max(r.identity_error for r in found) < 1e-9
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    for k in range(3):
        got = sorted(abs(r.whitened) for r in found if r.component == k + 1)
        assert np.allclose(got, sorted(abs(w[:, k])), atol=1e-9)
    for few in (rows.filter("false"), rows.filter("vec_id = 0"), rows.filter("vec_id = 105"), rows.filter("vec_id in (100, 101)")):
        assert whitening.whiten(few).count() == 0


def test_whitening_of_large_entries_and_equal_roots(spark):
    # Entries beyond 64 bits; and the corners of a cube, whose three roots are equal.
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert len(found) == 6 and found[0].deviation is None and max(r.identity_error for r in found) < 1e-6
    cube = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1), 0.0]) for i in range(8)]
    found = whitening.whiten(spark.createDataFrame(cube, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 24 and max(r.identity_error for r in found) < 1e-12
    assert all(math.isclose(r.explained, 1 / 3) for r in found)


def test_exact_polynomial_and_roots(spark):
    dice = np.random.default_rng(4)
    x = dice.integers(-9, 9, (5, 7)).tolist()  # of rank 5, so two roots are 0
    m = [[sum(r[i] * r[j] for r in x) for j in range(7)] for i in range(7)]
    # Faddeev and LeVerrier's recurrence in fractions.
    c, power = [Fraction(0)] * 7 + [Fraction(1)], [[Fraction(0)] * 7 for _ in range(7)]
    for k in range(1, 8):
        power = [[sum(m[i][l] * power[l][j] for l in range(7)) + (c[8 - k] if i == j else 0) for j in range(7)] for i in range(7)]
        c[7 - k] = -sum(sum(m[i][l] * power[l][i] for l in range(7)) for i in range(7)) / k
    found = whitening.characteristic_polynomial(spark, m)
    assert found == [int(v) for v in c] and found[:2] == [0, 0]
    values = sorted(np.linalg.eigvalsh(np.array(m, float)))[::-1]
    for k in range(1, 6):
        low, high, shift, before, together = whitening.root(found, k)
        assert before == k - 1 and together == 1 and math.isclose(high / 2**shift, values[k - 1], rel_tol=1e-9)
    # (t - 1)^2 (t - 1 - 2^-70) (t - 3): close roots are told apart, equal ones stay together.
    one, three = 1 << 70, 3 << 70
    roots = [one, one, one + 1, three]
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - (r * poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [whitening.root(poly, k)[3:] for k in (1, 2, 3, 4)] == [(0, 1), (1, 1), (2, 2), (2, 2)]


def test_null_space_of_repeated_roots():
    m = [[2, 0, 0], [0, 2, 0], [0, 0, 5]]
    basis = whitening.null_space(m, Decimal(2), 2).astype(float)
    assert np.allclose(basis @ basis.T, np.eye(2)) and np.allclose(basis[:, 2], 0)


def test_products_are_exact():
    for top in (3, 1 << 27, 1 << 40):
        x = np.random.default_rng(top).integers(-top, top, (50, 3))
        y = x.astype(object)
        assert (whitening.products(x) == y.T @ y).all()


# 13: periodic runs


def plain_runs(w, least=24, times=3):
    """All runs (start, length, period), by comparing all places at all distances."""
    out = []
    for q in range(1, len(w) // times + 1):
        start = 0
        for i in range(len(w) - q + 1):
            if i == len(w) - q or w[i] != w[i + q]:
                length = i - start + q
                if i > start and length >= max(least, times * q):
                    part = w[start : start + length]
                    if not any(part[r:] == part[:-r] for r in range(1, q)):
                        out.append((start, length, q))
                start = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text, change=True):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if change and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def runs_found(docs, change=periodic_runs.spread_period):
    return sorted((tuple(r) for r in periodic_runs.find_runs(docs, change).drop("text", "runs").collect()), key=str)


def test_runs_of_documents(small):
    rows = small.select("doc_id", "text").collect()
    found = runs_found(small)
    assert found == sorted((plain_document(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 10


def test_runs_of_odd_rows(spark, odd, empty):
    got = {r[0]: r for r in runs_found(odd.filter("doc_id <> 6"), None)}
    assert got[11][1:6] == (1, 1, 3000, 1, 3_000_000) and got[2][1:6] == (0, None, None, None, None)
    assert got[2][6:] == (hashlib.sha256(b"").hexdigest(),) * 2
    assert len(runs_found(odd)) == len(ODD) and runs_found(empty) == []
    short = [r for r in ODD if len(r[1] or "") < 5000]
    docs = spark.createDataFrame([r[:2] for r in short], "doc_id long, text string")
    assert runs_found(docs) == sorted((plain_document(*r[:2]) for r in short), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 40)), max_size=4), min_size=1, max_size=4), st.sampled_from([3, 9, 24]))
def test_runs_of_random_repeats(made, least):
    """Documents behind one another: every run of each, none across."""
    docs = [[x.encode() for part, n in doc for x in (part * n)[:n]] for doc in made]
    flat = [x for d in docs for x in d]
    if not flat:
        return
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    ids = periodic_runs.names_of(flat)
    found = periodic_runs.extended(ids, owner, periodic_runs.proposals(ids, owner), least)
    first = np.cumsum([0, *map(len, docs)])
    assert [tuple(r) for r in found.tolist()] == [(s + int(first[i]), length, q) for i, d in enumerate(docs) for s, length, q in plain_runs(d, least)]


def test_runs_of_a_long_text(spark):
    dice = random.Random(1)
    cycle = [f"w{dice.randrange(10**9)}" for _ in range(70_000)]
    text = " ".join(["start", *cycle * 4, "end"])
    found = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in found.runs] == [(1, 280_000, 70_000)]
    assert found.text == " ".join(["start", *cycle, "end"])


@pytest.mark.parametrize("doc_id", [None, 5, -3, "x"])
def test_period_is_spread_by_id(doc_id):
    w = [b"%d" % i for i in range(50)]
    h = zlib.crc32(str(doc_id).encode())
    changed = periodic_runs.spread_period(w, doc_id)
    assert len(changed) == 50 and (changed == w or (doc_id is not None and h % 10 == 0))
