"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Components become integers, so the scatter ``M = n * sum(y y') - s s'`` of the distinct vectors is an integer matrix
(n * n times the covariance) and Spark sums it exactly. Its characteristic polynomial is found modulo one 31-bit prime
after another, by reduction to Hessenberg form, each prime a row of a Spark job, and put together by Chinese
remainders; Maclaurin's inequality bounds the coefficients, so the number of primes is known beforehand. All roots are
real, so the sign changes of the polynomial shifted by t number exactly the roots above t: this isolates the largest
roots, and bisection by sign takes each to ``BITS`` binary places after the point. A component is the null space of
``M - root``, found by inverse iteration in integers of a few hundred bits, one row of a Spark job for each root.

The driver holds the scatter and the polynomial, whose size goes by the dimension alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import vectors
from marketlens.session import cut

#: Binary places of the roots after the point; roots of the scatter are n * n times the variances.
BITS = 96
#: Roots closer than this share of the trace span one null space and share a task.
CLOSE = Fraction(1, 1 << 64)
OWN = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: the fit list's size and sums, and unit components by falling variance."""

    scale: int
    dim: int
    n: int
    sums: tuple[int, ...]
    variance: tuple[float, ...]
    explained: tuple[float, ...]
    components: np.ndarray  # one row each
    identity_error: float | None

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer rows; the mean goes before anything is multiplied."""
        off = _off(y, self.n, self.sums)
        return (off.astype(np.float64) / self.n) @ (self.components / np.sqrt(np.array(self.variance))[:, None]).T


def _off(y: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * y - sums``, exact."""
    s = np.array(sums, object)
    if n * int(np.abs(y).max(initial=0)) + max((abs(x) for x in sums), default=0) < 1 << 62:
        return n * y - s.astype(np.int64)
    return n * y.astype(object) - s


def _rows(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    return df.where(vectors.valid(F.col(vec_col))).withColumn("__y", vectors.scaled(F.col(vec_col), scale))


def fit(df: DataFrame, vec_col: str = "embedding", scale: int = 64, components: int = 16) -> Whitening:
    """Fit on each distinct vector of ``floor(scale * component)`` once.

    Rows whose vector is null, is empty or holds a null or a non-finite component take no part, nor do rows of another
    length than the most frequent one. Components beyond 2^52 in size saturate there. Only components with a positive
    variance are kept, so at most the rank of the data; with one distinct vector or none there are none.
    """
    rows = _rows(df, vec_col, scale).select("__y")
    d = vectors.dimension(rows, "__y")
    if d == 0:
        return Whitening(scale, 0, 0, (), (), (), np.empty((0, 0)), None)
    distinct = cut(rows.where(F.size("__y") == d).distinct())
    n, sums, scatter = _scatter(distinct, d)
    poly = charpoly(df.sparkSession, scatter)
    roots = largest_roots(poly, components)
    if not roots:
        return Whitening(scale, d, n, tuple(sums), (), (), np.empty((0, d)), None)
    trace = sum(scatter[i][i] for i in range(d))
    unit = 1 << BITS
    model = Whitening(
        scale,
        d,
        n,
        tuple(sums),
        tuple(float(Fraction(r, unit * n * n)) for r in roots),
        tuple(float(Fraction(r, unit * trace)) for r in roots),
        _components(df.sparkSession, scatter, roots, trace),
        None,
    )
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(distinct, model)})


def _scatter(distinct: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and scatter, added up exactly: a task sends one number for each entry, Spark adds them by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            y = vectors.matrix(b.column(0), d)
            n, s, m = n + len(y), s + y.astype(object).sum(axis=0), m + vectors.product(y.T, y)
        i, j = np.triu_indices(d)
        at = [(-1, -1, n), *((k, -1, v) for k, v in enumerate(s)), *zip(i.tolist(), j.tolist(), m[i, j], strict=True)]
        a, b, v = zip(*at, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))], ["i", "j", "v"])

    parts = distinct.mapInArrow(run, "i int, j int, v decimal(38,0)")
    total = {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # d * (d + 3) / 2 + 1 rows
    n, s = total[-1, -1], [total[k, -1] for k in range(d)]
    return n, s, [[n * total[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ------------------------------------------------------------------ characteristic polynomial


def primes(count: int) -> list[int]:
    """The largest primes below 2^31: products of two residues stay within 62 bits."""
    small = [p for p in range(3, 46342, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))]
    out: list[int] = []
    top = (1 << 31) - 1
    while len(out) < count:
        span = np.ones(1 << 15, bool)  # top, top - 2, ...
        for p in small:
            first = (top % p) * pow(2, -1, p) % p
            span[first::p] = False
        out += [top - 2 * int(k) for k in np.flatnonzero(span)]
        top -= 2 << 15
    return out[:count]


def hessenberg_poly(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of ``det(x - a)``, the leading one first."""
    h, d = a % p, len(a)
    for m in range(1, d - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        i = m + int(found[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]  # of the leading blocks, lowest coefficient first
    for k in range(d):
        q = np.zeros(k + 2, np.int64)
        q[1:] = polys[k]
        q[:-1] = (q[:-1] - h[k, k] * polys[k] % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            q[: i + 1] = (q[: i + 1] - int(h[i, k]) * below % p * polys[i] % p) % p
        polys.append(q)
    return polys[d][::-1]


def charpoly(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Coefficients of ``det(x - scatter)``, the leading one first; the scatter has no negative eigenvalue."""
    d = len(scatter)
    mean = -(-sum(scatter[i][i] for i in range(d)) // d)
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    count = (2 * bound + 1).bit_length() // 30 + 2  # each prime has more than 30 bits
    moduli = primes(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            got = [hessenberg_poly(np.array([[x % moduli[k] for x in row] for row in scatter], np.int64), moduli[k]).tolist() for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["k", "c"])

    parts = max(1, min(count, spark.sparkContext.defaultParallelism))
    residues = {r["k"]: r["c"] for r in spark.range(0, count, 1, parts).mapInArrow(run, "k long, c array<long>").collect()}  # d + 1 numbers a prime
    out, whole = [0] * (d + 1), 1
    for k, p in enumerate(moduli):
        inverse = pow(whole, -1, p)
        out = [x + whole * ((r - x) * inverse % p) for x, r in zip(out, residues[k], strict=True)]
        whole *= p
    return [x - whole if x > whole // 2 else x for x in out]


# ------------------------------------------------------------------ roots


def _above(poly: list[int], at: int) -> int:
    """How many roots of a real-rooted polynomial lie above ``at``: the sign changes of ``poly(x + at)``."""
    c = list(poly)
    for top in range(len(c), 1, -1):
        for i in range(1, top):
            c[i] += c[i - 1] * at
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], most: int) -> list[int]:
    """The positive roots among the largest ``most``, falling, with their multiplicity, in units of 2^-BITS, rounded up."""
    d = len(poly) - 1
    q = [c << (BITS * k) for k, c in enumerate(poly)]  # its roots are 2^BITS times those of poly
    high = -q[1] if d else 0  # the trace
    found: list[int] = []
    if high <= 0:
        return found

    def refine(lo: int, hi: int, beyond: int) -> int:
        while hi - lo > 1:
            mid = (lo + hi) // 2
            v = 0
            for c in q:
                v = v * mid + c
            if v == 0:
                return mid
            # With k roots above it, the sign of a monic polynomial is that of (-1)^k.
            if (v > 0) == (beyond % 2 == 0):
                hi = mid
            else:
                lo = mid
        return hi

    open_ = [(0, high, _above(q, 0), 0)]  # (lo, hi], roots above lo, roots above hi
    while open_ and len(found) < most:
        lo, hi, above_lo, above_hi = open_.pop()
        if above_lo == above_hi:
            continue
        if above_lo - above_hi == 1:
            found.append(refine(lo, hi, above_hi))
        elif hi - lo == 1:
            found += [hi] * (above_lo - above_hi)
        else:
            mid = (lo + hi) // 2
            k = _above(q, mid)
            open_ += [(lo, mid, above_lo, k), (mid, hi, k, above_hi)]
    return found[:most]


# ------------------------------------------------------------------ components


def null_space(scatter: list[list[int]], root: int, count: int) -> np.ndarray:
    """``count`` orthonormal vectors that ``scatter - root`` all but annihilates, one a row: two steps of inverse
    iteration in fixed point, from fixed start vectors, made orthonormal after each."""
    d = len(scatter)
    point = BITS + 64 + 2 * max(1, sum(scatter[i][i] for i in range(d))).bit_length()  # places after the point
    a = np.array([[x << point for x in row] for row in scatter], object)
    for i in range(d):
        a[i, i] -= root << (point - BITS)
    lower = []
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        a[[k, i]] = a[[i, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        f = (a[k + 1 :, k] << point) // a[k, k]
        a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :]) >> point
        lower.append((i, f))
    out: list[np.ndarray] = [np.array([((7919 * (k + 1) * (j + 3)) % 9973) - 4986 for j in range(d)], object) << point for k in range(count)]
    for _ in range(2):
        done: list[np.ndarray] = []
        for v in out:
            b = v.copy()
            for k, (i, f) in enumerate(lower):
                b[k], b[i] = b[i], b[k]
                b[k + 1 :] -= (f * b[k]) >> point
            for k in range(d - 1, -1, -1):
                b[k] = ((b[k] - (int((a[k, k + 1 :] * b[k + 1 :]).sum()) >> point if k < d - 1 else 0)) << point) // a[k, k]
            b = _unit(b, point)
            for _again in range(2):
                for u in done:
                    b = b - ((u * (int((u * b).sum()) >> point)) >> point)
                b = _unit(b, point)
            done.append(b)
        out = done
    rows = np.array([[float(Fraction(int(x), 1 << point)) for x in v] for v in out])
    return rows * np.where(rows[np.arange(count), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


def _unit(v: np.ndarray, point: int) -> np.ndarray:
    """Length one, in fixed point."""
    size = math.isqrt(int((v * v).sum())) or 1
    return np.array([(int(x) << point) // size for x in v], object)


def _components(spark: SparkSession, scatter: list[list[int]], roots: list[int], trace: int) -> np.ndarray:
    """One row a root; roots that all but coincide are one row of the job and share its null space."""
    limit = int(CLOSE * trace * (1 << BITS))
    first = [0, *(k for k in range(1, len(roots)) if roots[k - 1] - roots[k] > limit)]
    sizes = np.diff([*first, len(roots)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            got = [null_space(scatter, roots[first[k]], sizes[k]).ravel().tolist() for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(got, pa.list_(pa.float64()))], ["k", "v"])

    parts = spark.range(0, len(first), 1, len(first)).mapInArrow(run, "k long, v array<double>")
    found = {r["k"]: r["v"] for r in parts.collect()}  # a d-vector for each component
    return np.array([x for k in range(len(first)) for x in found[k]]).reshape(len(roots), len(scatter))


def _summed(distinct: DataFrame, model: Whitening, mean: np.ndarray, product: bool) -> np.ndarray:
    """Over the fit list, the sum of the whitened rows less ``mean``, or of their products."""
    k, d = len(model.variance), model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k) if product else k)
        for b in batches:
            w = model.project(vectors.matrix(b.column(0), d)) - mean
            total = total + (w.T @ w if product else w.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "v"])

    parts = distinct.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k if product else k)
    for r in parts.collect():  # k * k rows at most
        out[r["i"]] = r["v"]
    return out.reshape(k, k) if product else out


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    mean = _summed(distinct, model, np.zeros(len(model.variance)), False) / model.n
    cov = _summed(distinct, model, mean, True) / model.n
    return float(np.abs(cov - np.eye(len(cov))).max())


# ------------------------------------------------------------------ rows


def transform(df: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """Rows that could take part in the fit, once for each component: own columns, then component (from 1), n,
    deviation (sum of ``(n * y - sums)^2``, exact), whitened, explained, identity_error. Own columns of these names give
    way. Repeated rows stay, equal vectors get equal values; a model without components gives no rows."""
    own = [c for c in df.columns if c not in OWN]
    rows = _rows(df.select(*own), vec_col, model.scale).where(F.size("__y") == model.dim)
    k = len(model.variance)
    fields = [*df.select(*own).schema.fields]
    added = [
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not k:
                continue
            y = vectors.matrix(b.column(len(own)), model.dim)
            off = _off(y, model.n, model.sums)
            big = off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * model.dim >= 1 << 63
            square = ((off.astype(object) if big else off) ** 2).sum(axis=1)
            take = pa.array(np.repeat(np.arange(len(y)), k))
            m = len(take)
            cols = [
                pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()),
                pa.array(np.full(m, model.n), pa.int64()),
                pa.array([Decimal(int(x)) if abs(int(x)) < 10**38 else None for x in square], pa.decimal128(38, 0)).take(take),
                pa.array(model.project(y).ravel(), pa.float64()),
                pa.array(np.tile(np.array(model.explained), len(y)), pa.float64()),
                pa.array(np.full(m, model.identity_error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(own))), *cols], [*own, *(f.name for f in added)])

    return rows.mapInArrow(run, T.StructType([*fields, *added]))
