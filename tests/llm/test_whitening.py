"""Whitening against exact integers and numpy's eigenvectors, and its edge cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import whitening

VECS = "vec_id long, embedding array<double>, n string, component int"


def exact_poly(a):
    """Faddeev and LeVerrier's recursion in fractions."""
    d = len(a)
    m, out = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)], [1]
    for k in range(1, d + 1):
        am = [[sum(a[i][x] * m[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(am[i][i] for i in range(d)) / k
        out.append(int(c))
        m = [[am[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial_is_exact(spark, seed):
    r = np.random.default_rng(seed)
    x = r.integers(-10**9, 10**9, (7, 4 + seed)).astype(object)
    if seed == 3:
        x[:, 1] = 2 * x[:, 0]  # singular
        x[:, 2] = 0
    a = (x.T @ x).tolist()
    assert whitening.charpoly(spark, a) == exact_poly(a)


def test_primes():
    got = whitening.primes(300)
    assert len(set(got)) == 300 and all(p < 1 << 31 and pow(2, p - 1, p) == 1 and pow(3, p - 1, p) == 1 for p in got)
    assert got[:2] == [(1 << 31) - 1, (1 << 31) - 19]


def test_roots_keep_multiplicity_and_order():
    # (x - 5)^3 (x - 2) x^2
    poly = [1]
    for root in (5, 5, 5, 2, 0, 0):
        poly = [a - root * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    got = whitening.largest_roots(poly, 16)
    assert [r / 2**whitening.BITS for r in got] == [5, 5, 5, 2]
    assert whitening.largest_roots([1, -2, -0], 1) == [2 << whitening.BITS]
    assert [r / 2**whitening.BITS for r in whitening.largest_roots([1, 0 - 3, 1], 2)] == pytest.approx([(3 + math.sqrt(5)) / 2, (3 - math.sqrt(5)) / 2], abs=1e-15)


def brute(rows, d):
    """Remaining rows and whitened coordinates by numpy, signs as they come."""
    kept = [(i, v) for i, v, *_ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    y = np.array([[math.floor(64 * c) for c in v] for _, v in kept])
    u = np.unique(y, axis=0)
    n, s = len(u), u.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    keep = [k for k in range(d - 1, -1, -1) if e[k] > 1e-9][:16]
    return kept, n, ((n * y - s) ** 2).sum(axis=1), (y - s / n) @ v[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def test_rows_equal_numpy(spark):
    r = random.Random(3)
    d = 5
    rows = [(k, [r.gauss(0, 1 + j) for j in range(d)], "x", 9) for k in range(120)]
    rows += [(200, rows[0][1], None, None), (0, rows[0][1], "x", 9), (None, rows[1][1], None, None)]
    rows += [(300, None, "", 0), (301, [], "", 0), (302, [1.0, None, 0.0, 0.0, 0.0], "", 0), (303, [float("nan")] * d, "", 0), (304, [float("inf")] * d, "", 0), (305, [1.0, 2.0], "", 0)]
    df = spark.createDataFrame(rows, VECS)
    model = whitening.fit(df)
    got = whitening.transform(df, model)
    assert got.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept, n, dev, white, explained = brute(rows, d)
    out = {}
    for x in got.collect():
        out.setdefault(x["vec_id"], []).append(x)
    assert set(out) == {i for i, _ in kept} and len(out[0]) == 2 * d
    per = {i: sorted(v, key=lambda x: x["component"])[:: 2 if i == 0 else 1] for i, v in out.items()}
    have = np.array([[x["whitened"] for x in per[i]] for i, _ in kept])
    sign = np.sign((have * white).sum(axis=0))
    assert np.abs(have - white * sign).max() < 1e-11
    assert {x["n"] for v in out.values() for x in v} == {n} == {120}
    assert [int(per[i][0]["deviation"]) for i, _ in kept] == dev.tolist()
    assert np.allclose([x["explained"] for x in per[1]], explained, rtol=1e-12)
    errors = {x["identity_error"] for v in out.values() for x in v}
    assert len(errors) == 1 and errors.pop() < 1e-12


def test_equal_variances_and_low_rank(spark):
    """Four unit directions of the same variance, and a dimension that never moves."""
    rows = [(2 * k + s, [float((1 - 2 * s) * (j == k)) for j in range(4)] + [7.0], "", 0) for k in range(4) for s in range(2)]
    df = spark.createDataFrame(rows, VECS)
    model = whitening.fit(df)
    assert len(model.variance) == 4 and np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-15)
    assert model.identity_error < 1e-12 and np.allclose(model.explained, 0.25)
    assert whitening.transform(df, model).count() == 32


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], VECS)
    assert whitening.transform(df, whitening.fit(df)).count() == 0
    empty = df.limit(0)
    assert whitening.transform(empty, whitening.fit(empty)).count() == 0


def test_huge_components(spark):
    rows = [(k, [float(10**k), -float(3**k)], "", 0) for k in range(12)] + [(99, [1e300, -1e300], "", 0)]
    df = spark.createDataFrame(rows, VECS)
    got = whitening.transform(df, whitening.fit(df)).where(F.col("component") == 1).collect()
    y = {k: [min(max(math.floor(64 * c), -(1 << 52)), 1 << 52) for c in v] for k, v, *_ in rows}
    s = [sum(v[j] for v in y.values()) for j in range(2)]
    assert {x["vec_id"]: int(x["deviation"]) for x in got} == {k: sum((13 * v[j] - s[j]) ** 2 for j in range(2)) for k, v in y.items()}
