"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers x = floor(256 * c). Over the fit list, each distinct x vector once, the scatter n * sum(x x') - S S' is an integer matrix, n * n times the
covariance. Its characteristic polynomial is worked out modulo many primes, a Spark row for each prime, by reduction to Hessenberg form, and put together by
Chinese remaindering, exactly. As a symmetric matrix has real roots only, the roots above a are as many as the sign changes of the
polynomial's coefficients after a shift by a, so bisection with exact integers isolates each root; a simple one is then narrowed by the sign
of the polynomial, to 2^-110 of its size. Components come from inverse iteration for the null space of (scatter - root) with 120 digits; roots
that stay together at that width have a null space of several dimensions, of which an orthonormal basis is taken. A Spark row for each component.

What reaches the driver has the size of the dimensions squared and does not grow with the rows: sums over all vectors are exact integers, taken per task and added up by Spark
in three parts of 48 bits. Whitening itself needs no shuffle.

Defined results: rows whose vector is NULL or has NULL, NaN or infinite entries go. Vectors of another length than the commonest (of equally common ones the
longest) lack entries and go as well. Integers beyond 64 bits become the nearest one that fits. Repeated vectors count once in the fit and are whitened each. Only components with a
positive eigenvalue exist, so a fit list of one vector, vectors of length 0 and an empty table give no rows. A component's sign makes its largest entry (the first of equal ones) positive. ``deviation`` is NULL
where it is beyond 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlight.llm.common import stored, type_of

SCALE, COMPONENTS = 256, 4
DIGITS, WIDTH = 120, 110
_PART = 48
_MASK = (1 << _PART) - 1
_FRACTION = 60


# Integer vectors


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows with finite entries and the commonest length, with x."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & finite)
    common = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size(vector) == (common["length"] if common else 0))
    return rows.withColumn("x", integers(F.col(vector), scale))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def size_of(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly: in doubles where all sums are below 2^53, else in 64-bit or Python's integers."""
    most = size_of(x) ** 2 * len(x)
    if most < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64)
    if most >= 1 << 63:
        x = x.astype(object)
    return x.T @ x


# Exact sums over all rows


def exact_sums(rows: DataFrame, width: int, make: Callable[[pa.RecordBatch], np.ndarray]) -> list[int]:
    """Sums of ``width`` integers over all batches. make: a batch's integers; each task adds up its own, Spark adds those of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                total = total + make(batch).astype(object)
        parts = [[v >> 2 * _PART for v in total], [v >> _PART & _MASK for v in total], [v & _MASK for v in total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], ["at", "high", "middle", "low"])

    added = rows.mapInArrow(run, "at int, high long, middle long, low long").groupBy("at")
    found = added.agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "middle", "low"))).collect()
    out = [0] * width
    for r in found:
        out[r["at"]] = (int(r["high"]) << 2 * _PART) + (int(r["middle"]) << _PART) + int(r["low"])
    return out


def scatter_of(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * sum(x x') - S S' of the fit list."""

    def make(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix_of(batch.column("x"))
        sums = x.sum(0) if size_of(x) * len(x) < 1 << 63 else x.astype(object).sum(0)
        return np.concatenate([np.array([len(x)], object), sums.astype(object), products(x)[np.triu_indices(d)].astype(object)])

    n, *rest = exact_sums(fit.select("x"), 1 + d + d * (d + 1) // 2, make)
    sums, upper = rest[:d], iter(rest[d:])
    scatter = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            scatter[i][j] = scatter[j][i] = n * next(upper) - sums[i] * sums[j]
    return n, sums, scatter


# The characteristic polynomial


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        v = pow(base, odd, n)
        if v not in (1, n - 1) and not any((v := v * v % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product is above ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, from the constant upwards; matrix: of Python's integers."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        at = k + 1 + pivots[0]
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(d):
        # Of the leading block of k + 1 rows, from those of fewer rows.
        factors, below = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            factors[i] = h[i, k] * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        polynomials[k + 1, 1:] = polynomials[k, :-1]
        polynomials[k + 1] = (polynomials[k + 1] - (factors[:, None] * polynomials[: k + 1] % p).sum(0)) % p
    return polynomials[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(t - matrix) for a symmetric matrix without negative eigenvalues, from the constant upwards."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The sums of products of k roots are largest where all roots are equal.
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes = primes_for(2 * bound + 1)
    whole = np.array(matrix, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [polynomial_modulo(whole, p) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    found = rows.mapInArrow(run, "p long, c array<long>").collect()  # d + 1 numbers for each prime
    product = math.prod(primes)
    total = [0] * (d + 1)
    for r in found:
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        total = [t + c * unit for t, c in zip(total, r["c"])]
    return [t - product if 2 * t > product else t for t in (t % product for t in total)]


# Roots


def _shifted_signs(c: list[int], a: int, shift: int) -> int:
    """Sign changes of the coefficients of c(t + a / 2^shift): how many roots are above a / 2^shift, if all are real."""
    d = len(c) - 1
    c = [v << shift * (d - k) for k, v in enumerate(c)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(c: list[int], a: int, shift: int) -> int:
    """Sign of c(a / 2^shift)."""
    value, d = 0, len(c) - 1
    for k in range(d, -1, -1):
        value = value * a + (c[k] << shift * (d - k))
    return (value > 0) - (value < 0)


def root(c: list[int], number: int, width: int = WIDTH) -> tuple[int, int, int, int, int]:
    """The number-th largest root as (low, high, shift, before, together): low < root * 2^shift <= high, with ``before`` larger roots and ``together`` in the interval.

    c: a polynomial with real roots only, of which that many are positive. The interval is 2^-width of the root or less.
    """
    low, high, shift = 0, 1, 0
    above_low, above_high = _shifted_signs(c, 0, 0), _shifted_signs(c, 1, 0)
    while above_high >= number:  # doubling up to the root's size
        low, above_low, high = high, above_high, 2 * high
        above_high = _shifted_signs(c, high, shift)
    end = 0
    while (high - low) << width > low:
        if (high - low) % 2:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        if above_low - above_high == 1:
            end = end or _sign(c, high, shift) or -_sign(c, low, shift) or 1
            above = above_high if (at := _sign(c, middle, shift)) == end or at == 0 else above_low
        else:
            above = _shifted_signs(c, middle, shift)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, high, shift, above_high, above_low - above_high


# Components


def null_space(matrix: list[list[int]], value: Decimal, size: int, digits: int = DIGITS, rounds: int = 3) -> np.ndarray:
    """Orthonormal rows spanning the ``size`` directions in which (matrix - value) is all but zero, by inverse iteration with ``digits`` digits."""
    with localcontext() as context:
        context.prec = digits
        d = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= value
        tiny = (max(abs(v) for v in a.ravel()) or Decimal(1)) * Decimal(10) ** (5 - digits)
        order = np.arange(d)
        for k in range(d):
            at = k + int(np.argmax(np.abs(a[k:, k])))
            if at != k:
                a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * a[k, k + 1 :]
        basis = np.array([[Decimal(int(v)) for v in row] for row in np.random.default_rng(12).integers(1, 1 << 30, (size, d))], object)
        for _ in range(rounds):
            for s in range(size):
                y = basis[s][order]
                for k in range(1, d):
                    y[k] -= a[k, :k] @ y[:k]
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1 :] @ y[k + 1 :] if k + 1 < d else 0)) / a[k, k]
                for _ in range(2):  # twice, as the rows may be all but parallel
                    y = y / (y @ y).sqrt()
                    for other in basis[:s]:
                        y = y - other * (other @ y)
                basis[s] = y / (y @ y).sqrt()
        return basis


def components_of(spark: SparkSession, matrix: list[list[int]], c: list[int], count: int) -> list[tuple[Decimal, list[float]]]:
    """The largest eigenvalues of the matrix and unit vectors, by falling value; c: its characteristic polynomial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("number").to_pylist():
                low, high, shift, before, together = root(c, number)
                with localcontext() as context:
                    context.prec = DIGITS
                    value = Decimal(low + high) / (1 << shift + 1)
                    vector = null_space(matrix, value, together)[number - before - 1]
                    unit = [float(v) for v in vector]
                if unit[int(np.argmax(np.abs(unit)))] < 0:
                    unit = [-v for v in unit]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([str(value)]), pa.array([unit], pa.list_(pa.float64()))], ["number", "value", "vector"])

    rows = spark.createDataFrame([(k,) for k in range(1, count + 1)], "number int").repartition(count)
    found = sorted(rows.mapInArrow(run, "number int, value string, vector array<double>").collect())
    return [(Decimal(r["value"]), r["vector"]) for r in found]


# Whitening


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    if n * size_of(x) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exactly; None beyond 64 bits."""
    if size_of(y) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    exact = (y.astype(object) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def projected(y: np.ndarray, found: list[tuple[Decimal, list[float]]]) -> list[np.ndarray]:
    """Whitened values of each component for the rows of n * x - S; a row's sum does not depend on the other rows."""
    y = y.astype(np.float64)
    return [(y * np.array(v)).sum(1) / math.sqrt(value) for value, v in found]


def whiten(vectors: DataFrame, count: int = COMPONENTS, row_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row_id, component, n, deviation, whitened, explained, identity_error of each usable row and component."""
    spark = vectors.sparkSession
    kind = type_of(vectors, row_id)
    schema = f"{row_id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors.select(row_id, vector), vector, scale).select(row_id, "x")
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    if not d:
        return spark.createDataFrame([], schema)
    fit = stored(rows.select("x").distinct(), "fit-list")
    n, sums, scatter = scatter_of(fit, d)
    c = characteristic_polynomial(spark, scatter)
    count = min(count, _shifted_signs(c, 0, 0))
    if not count:
        return spark.createDataFrame([], schema)
    found = components_of(spark, scatter, c, count)
    trace = sum(scatter[i][i] for i in range(d))
    explained = [float(value / trace) for value, _ in found]
    pairs = [(a, b) for a in range(count) for b in range(a, count)]

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = projected(centred(matrix_of(batch.column("x")), n, sums), found)
        values = [math.fsum(v) for v in w] + [math.fsum(w[a] * w[b]) for a, b in pairs]
        return np.array([int(math.ldexp(v, _FRACTION)) for v in values], object)

    added = [math.ldexp(v, -_FRACTION) / n for v in exact_sums(fit.select("x"), count + len(pairs), moments)]
    error = max(abs(v - added[a] * added[b] - (a == b)) for v, (a, b) in zip(added[count:], pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = centred(matrix_of(batch.column("x")), n, sums)
            deviation, size = deviations(y), len(y)
            for k, values in enumerate(projected(y, found)):
                same = lambda v, t: pa.array(np.full(size, v), t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(row_id), same(k + 1, pa.int32()), same(n, pa.int64()), pa.array(deviation, pa.int64()), pa.array(values), same(explained[k], pa.float64()), same(error, pa.float64())],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return rows.mapInArrow(run, schema)
