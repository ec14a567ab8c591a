"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Components become integers, so the scatter matrix of the distinct vectors is an integer matrix
``M = n * sum(y y') - T T'`` (n**2 times the covariance; y are the vectors less a whole number
near their mean, T their sum), added up exactly by distributed sums.  Its
characteristic polynomial is computed modulo enough primes (each by reduction to Hessenberg
form, one task for some primes) and put together by Chinese remaindering.  All its roots are
real, so the sign changes of the shifted polynomial count the roots beyond a point exactly
(Budan and Fourier): every task isolates one root by bisection and refines it to ``PRECISION``
bits.  Its component is the null space of ``M`` less the root, by inverse iteration in
whole-number arithmetic.  Roots that agree in ``PRECISION`` bits are one eigenvalue of that
multiplicity, whose components are orthonormal.

The driver and each task hold dims x dims numbers; rows are only ever read in slices.

Defined cases: rows whose vector is NULL, or holds a NULL or non-finite entry, take no part;
nor those whose length is not the most frequent one (the smallest of the most frequent), nor
those with an entry beyond +-2**34 (their products need not be exact); a NULL ``vec_id`` stays;
repeated vectors are fitted once and whitened each; components of eigenvalue zero cannot be
whitened and are left out, so fewer than ``components`` come from tables of lower rank, and no
row at all if no entry varies; a ``deviation`` that no long holds is NULL; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.common import ship, stored

#: bits to which roots are refined, relative to the largest possible root
PRECISION = 192
#: bits after the point in inverse iteration
_FRACTION = 3 * PRECISION
_LARGEST = float(1 << 34)


def integer_vectors(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, x)``: the usable rows as longs ``floor(scale * entry) + shift``."""
    v = F.col("v")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(_LARGEST))
    kept = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
            .filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    whole = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))
    return kept.filter(F.size("v") == (lengths["d"] if lengths else 0)).select("vec_id", whole.alias("x"))


# --- distributed sums

def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], exact: bool, slice_rows: int = 1024) -> np.ndarray:
    """The sum of ``part(matrix of some rows)``, a vector of fixed length, over all rows (column ``x``)."""
    kind = "decimal(38,0)" if exact else "double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, slice_rows):
                found = part(_matrix(b.column(0).slice(lo, slice_rows)))
                found = found.astype(object) if exact else found
                total = found if total is None else total + found
        if total is not None:
            values = (pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)) if exact else pa.array(total, pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], ["at", "part"])

    sums = rows.select("x").mapInArrow(each, f"at int, part {kind}").groupBy("at").agg(F.sum("part").alias("s"))
    return np.array([int(r["s"]) if exact else r["s"] for r in sorted(sums.collect())], object if exact else float)  # as many as part gives


def _outer(y: np.ndarray) -> np.ndarray:
    """Upper half of ``y' y``, exact."""
    upper = np.triu_indices(y.shape[1])
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) >= 1 << 62:
        y = y.astype(object)
    return (y.T @ y)[upper]


def scatter(distinct: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """``n``, the sums ``S`` and the integer matrix ``M``, n**2 times the covariance, of the rows' vectors ``x``."""
    ones = lambda x: np.append(x.astype(object).sum(axis=0), len(x))
    *sums, n = _totals(distinct, ones, True).tolist()
    near = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(dims)
    m = np.zeros((dims, dims), object)
    m[upper] = _totals(distinct, lambda x: _outer(x - near), True)
    t = [s - n * int(a) for s, a in zip(sums, near)]
    m[upper] = [n * v - t[i] * t[j] for v, i, j in zip(m[upper], *upper)]
    lower = upper[1], upper[0]
    m[lower] = m[upper]
    return n, np.array(sums, object), m


# --- the characteristic polynomial

def primes(bits: int) -> list[int]:
    """Primes below 2**31, from the largest down, whose product has more than ``bits`` bits."""
    small = [p for p in range(2, 46341) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out, top, got = [], 1 << 31, 0.0
    while got <= bits:
        lo = top - 65536
        sieve = np.ones(65536, bool)
        for p in small:
            sieve[-lo % p::p] = False
        for q in (np.flatnonzero(sieve)[::-1] + lo).tolist():
            out.append(q)
            got += math.log2(q)
            if got > bits:
                break
        top = lo
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (lowest first) of ``det(x - m)`` modulo the prime ``p`` < 2**31: similarity to
    Hessenberg form, then the recurrence of its leading minors."""
    d = len(m)
    h = np.array([[int(v) % p for v in row] for row in m], np.int64)
    for c in range(d - 2):
        found = np.flatnonzero(h[c + 1:, c])
        if not len(found):
            continue
        k = c + 1 + int(found[0])
        if k != c + 1:
            h[[c + 1, k]] = h[[k, c + 1]]
            h[:, [c + 1, k]] = h[:, [k, c + 1]]
        u = h[c + 2:, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2:] = (h[c + 2:] - u[:, None] * h[c + 1] % p) % p
        h[:, c + 1] = (h[:, c + 1] + (h[:, c + 2:] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - h[k - 1, k - 1] * minors[k - 1] % p) % p
        below = 1
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            minors[k] = (minors[k] - int(h[i, k - 1]) * below % p * minors[i] % p) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients (lowest first) of ``det(x - m)`` of an integer matrix without negative eigenvalues."""
    d = len(m)
    # the coefficients' absolute values sum up to prod(1 + eigenvalue) <= (1 + trace / d) ** d
    mean = sum(int(m[i, i]) for i in range(d)) // d + 2
    wanted = primes(int(d * (mean.bit_length() + 1)) + 2)
    rows = [[int(v) for v in r] for r in m]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()),
                                              pa.array([polynomial_mod(rows, p) for p in ps], pa.list_(pa.int64()))], ["p", "c"])

    tasks = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(min(len(wanted), 64))
    left, product = [0] * (d + 1), 1
    for r in sorted(tasks.mapInArrow(each, "p long, c array<long>").collect()):  # d + 1 numbers a prime
        p = r["p"]
        inverse = pow(product, -1, p)
        left = [x + product * ((c - x) * inverse % p) for x, c in zip(left, r["c"])]
        product *= p
    return [x - product if 2 * x > product else x for x in left]


# --- real roots

def roots_beyond(poly: list[int], a: int) -> int:
    """Number of roots (with multiplicity) above the integer ``a`` of a polynomial with real roots only."""
    c = list(poly)
    for i in range(len(c) - 1):  # c becomes the polynomial of x + a
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of ``poly``."""
    d = len(poly) - 1
    return [c << bits * (d - k) for k, c in enumerate(poly)]


def value(poly: list[int], a: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * a + c
    return out


def isolate(poly: list[int], number: int, top: int) -> tuple[int, int, int, int]:
    """The root of ``number`` (1: the largest), all being real, none negative and at most ``top``: ``(a, bits,
    above, multiplicity)``; it lies within 2**-bits of ``a / 2**bits``, with ``above`` roots above its interval
    and ``multiplicity`` in it."""
    low, high, bits = -1, top, 0  # roots in (low, high] / 2**bits
    many, few = len(poly) - 1, 0
    most = max(PRECISION - top.bit_length(), 1)
    now = poly
    while many - few > 1:
        if high - low == 1:
            if bits >= most:
                return high, bits, few, many - few
            bits, low, high = bits + 16, low << 16, high << 16
            now = scaled(poly, bits)
        middle = (low + high) // 2
        n = roots_beyond(now, middle)
        if n >= number:
            low, many = middle, n
        else:
            high, few = middle, n
    # one root, and a change of sign: halve
    extra = max(most - bits, 0)
    now, low, high = scaled(poly, bits + extra), low << extra, high << extra
    positive = value(now, high) > 0 if value(now, high) else None
    while high - low > 1 and positive is not None:
        middle = (low + high) // 2
        v = value(now, middle)
        if not v:
            return middle, bits + extra, few, 1
        low, high = (low, middle) if (v > 0) == positive else (middle, high)
    return high, bits + extra, few, 1


# --- null space

def null_space(m: list[list[int]], a: int, bits: int, vectors: int, seed: int = 1) -> np.ndarray:
    """``vectors`` orthonormal rows that span the null space of ``m - a / 2**bits``, as integers of
    ``_FRACTION`` bits after the point: inverse iteration on an elimination with row pivots."""
    d = len(m)
    size = max(max(abs(v) for row in m for v in row), 1).bit_length()
    one = 1 << _FRACTION
    rows = np.array([[(((v << bits) - (a if i == j else 0)) << _FRACTION) >> (bits + size) for j, v in enumerate(row)]
                     for i, row in enumerate(m)], object)
    order, steps = list(range(d)), []
    for c in range(d):
        k = c + max(range(d - c), key=lambda i: abs(rows[c + i, c]))
        if k != c:
            rows[[c, k]] = rows[[k, c]]
            order[c], order[k] = order[k], order[c]
            for step in steps:
                step[c], step[k] = step[k], step[c]
        if not rows[c, c]:
            rows[c, c] = 1
        factor = np.zeros(d, object)
        factor[c + 1:] = [(int(v) << _FRACTION) // int(rows[c, c]) for v in rows[c + 1:, c]]
        rows[c + 1:, c:] -= (factor[c + 1:, None] * rows[c, c:][None]) >> _FRACTION
        rows[c + 1:, c] = 0
        steps.append(factor)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b[order].copy()
        for c in range(d):
            b[c + 1:] -= (steps[c][c + 1:] * b[c]) >> _FRACTION
        for c in range(d - 1, -1, -1):
            b[c] = (int(b[c]) << _FRACTION) // int(rows[c, c])
            b[:c] -= (rows[:c, c] * b[c]) >> _FRACTION
        return b

    def unit(v: np.ndarray) -> np.ndarray:
        top = max(int(abs(x)).bit_length() for x in v)
        v = np.array([(int(x) << 2 * _FRACTION) >> top for x in v], object)
        length = math.isqrt(sum(int(x) * int(x) for x in v))
        return np.array([(int(x) << _FRACTION) // length for x in v], object)

    luck = random.Random(seed)
    found = np.array([[luck.getrandbits(40) * one >> 40 for _ in range(d)] for _ in range(vectors)], object)
    for _ in range(3):
        done: list[np.ndarray] = []
        for b in found:
            v = unit(solve(b))
            for _ in range(2):
                for u in done:
                    v = v - ((u * (int((u * v).sum()) >> _FRACTION)) >> _FRACTION)
                v = unit(v)
            done.append(v)
        found = np.array(done, object)
    return found


def principal(spark: SparkSession, m: np.ndarray, components: int) -> list[tuple[int, float, float, list[float]]]:
    """``(number, eigenvalue, share of the trace, unit vector)`` of the ``components`` largest positive
    eigenvalues of the integer matrix ``m``, each found in a task of its own."""
    trace = sum(int(m[i, i]) for i in range(len(m)))
    if not trace:
        return []
    poly = characteristic_polynomial(spark, m)
    rows = [[int(v) for v in r] for r in m]
    positive = roots_beyond(poly, 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column(0).to_pylist():
                a, bits, above, many = isolate(poly, number + 1, trace)
                v = null_space(rows, a, bits, many)[number - above]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number + 1], pa.int32()), pa.array([a / (1 << bits)]), pa.array([a / (trace << bits)]),
                     pa.array([[int(x) / (1 << _FRACTION) for x in v]], pa.list_(pa.float64()))], ["number", "value", "share", "v"])

    n = min(components, positive)
    found = spark.range(n, numPartitions=n).mapInArrow(each, "number int, value double, share double, v array<double>").collect()
    return sorted((r["number"], r["value"], r["share"], r["v"]) for r in found)  # components x dims numbers


# --- whitening

def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable
    row of ``vectors (vec_id, embedding)`` and each of the ``components`` first components."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = stored(integer_vectors(vectors, scale, shift), "integers")
    one = x.select(F.size("x").alias("d")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    distinct = stored(x.select("x").distinct(), "distinct")
    n, sums, m = scatter(distinct, one["d"])
    found = principal(spark, m, components)
    if not found:
        return spark.createDataFrame([], schema)
    near = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) - n * int(a) for s, a in zip(sums, near)], np.int64)  # 0 to n - 1
    # n**2 e is the eigenvalue of m, so (x - S / n) / sqrt(e) is (n x - S) / sqrt(n**2 e)
    axes = np.array([np.array(v) / math.sqrt(value) for _, value, _, v in found]).T

    def whitened(xs: np.ndarray) -> np.ndarray:
        return (xs - near) @ (axes * n) - rest @ axes

    means = _totals(distinct, lambda xs: whitened(xs).sum(axis=0), False) / n
    products = lambda xs: ((w := whitened(xs) - means).T @ w).ravel()
    k = len(found)
    covariance = _totals(distinct, products, False).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    numbers = np.array([f[0] for f in found], np.int32)
    explained = np.array([f[2] for f in found])

    def deviations(xs: np.ndarray) -> list[int | None]:
        far = np.abs((xs - near).astype(float) * n - rest).max(axis=1, initial=0) ** 2 * xs.shape[1]
        apart = (xs - near) * (n if far.max() < 2.0**62 else n + np.zeros(1, object)) - rest
        out = (apart * apart).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                some = b.slice(lo, 512)
                xs = _matrix(some.column(1))
                rows = np.repeat(np.arange(len(xs)), k)
                many = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows)), pa.array(np.tile(numbers, len(xs))), pa.array(np.full(many, n, np.int64)),
                     pa.array(deviations(xs), pa.int64()).take(pa.array(rows)), pa.array(whitened(xs).ravel()),
                     pa.array(np.tile(explained, len(xs))), pa.array(np.full(many, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(each, schema)
