from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from glossmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component string"


def whiten(spark, vectors, **how):
    rows = [(i, v, 1, 2, "x", "c") for i, v in enumerate(vectors)]
    return [r.asDict() for r in whitening.whiten(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()]


def plainly(vectors, components=4):
    """Integers, distinct vectors and exact covariance by fractions; vec_id: (deviation, whitened up to signs)."""
    kept = {i: tuple(math.floor(float(np.float32(c)) * 256) for c in v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(kept.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    covariance = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    values, vectors_ = np.linalg.eigh(np.array([[float(v) for v in row] for row in covariance]))
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in kept.items():
        z = [n * a - s for a, s in zip(x, sums)]
        out[i] = sum(v * v for v in z), np.array([float(Fraction(v, n)) for v in z]) @ vectors_[:, order] / np.sqrt(values[order])
    trace = float(sum(covariance[i][i] for i in range(d)))
    return n, out, values[order] / trace


def vectors_of(seed, n, d, offset=0.0, scale=1.0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) * np.linspace(1, 3, d) * scale + offset
    return [[float(np.float32(c)) for c in row] for row in v]


@pytest.mark.parametrize(("offset", "scale"), [(0.0, 1.0), (3000.0, 0.02), (-1e9, 1e4), (1e15, 1e13)])
def test_equals_exact_arithmetic(spark, offset, scale):
    vectors = vectors_of(1, 150, 6, offset, scale)
    vectors += vectors[:40] * 3 + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    n, want, explained = plainly(vectors)
    got = whiten(spark, vectors)
    assert len(got) == 4 * len(want)
    signs = {}
    for r in got:
        deviation, w = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and (r["deviation"] is None if deviation >= 10**38 else int(r["deviation"]) == deviation)
        sign = signs.setdefault(k, np.sign(w[k] * r["whitened"]))
        assert abs(sign * r["whitened"] - w[k]) < 1e-6
        assert abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-6
    assert {r["component"] for r in got} == {1, 2, 3, 4}


def test_small_and_degenerate_inputs(spark):
    assert whiten(spark, []) == []
    assert whiten(spark, [None, [None]]) == []
    assert whiten(spark, [[1.0, 2.0]] * 5) == []  # no variance
    assert whiten(spark, [[], []]) == []
    two = whiten(spark, [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]])
    assert [r["component"] for r in two] == [1] * 3 and {round(abs(r["whitened"]), 9) for r in two} == {1.0} and {r["n"] for r in two} == {2}
    odd = whiten(spark, [[0.0, 0.5], [1.0, 0.0], [0.5, 1.0], [3.0], []])  # other lengths are left out
    assert {r["vec_id"] for r in odd} == {0, 1, 2}
    assert {r["component"] for r in whiten(spark, [[float(i)] for i in range(5)])} == {1}


def test_floors_and_negative_zero(spark):
    rows = [(1, [-0.0, -0.001, 0.999 / 256, 1.0])]
    x = whitening.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding").head()["x"]
    assert x == [0, -1, 0, 256]


@pytest.mark.parametrize("size", [10, 2**17, 2**18 - 1, 2**40, 2**61])
def test_cross_sums_are_exact(size):
    r = np.random.default_rng(3)
    y = r.integers(-size, size, (70, 3), dtype=np.int64)
    y[0] = [size, -size, size - 1]
    have = whitening.cross_sums(iter([y[:30], y[30:30], y[30:]]), 4)
    rows = [[*map(int, row), 1] for row in y]
    for i in range(4):
        for j in range(4):
            assert sum(int(m[i, j]) << (whitening.BITS * k) for k, m in have.items()) == sum(a[i] * a[j] for a in rows)


def test_sums_carry(monkeypatch):
    monkeypatch.setattr(whitening, "CARRY", 1 << 20)
    y = np.full((1000, 2), 2**17 - 1, np.int64)
    have = whitening.cross_sums(iter([y] * 5), 3)
    assert sum(int(m[0, 1]) << (whitening.BITS * k) for k, m in have.items()) == 5000 * (2**17 - 1) ** 2 and max(have) > 1


def test_squares_of_any_size():
    for z in ([[3, -4]], [[2**49, -(2**49)]], [[2**60, 1]]):
        assert whitening.squares(np.array(z, np.int64)) == [sum(v * v for v in z[0])]
    assert whitening.squares(np.array([[10**30, 1]], object)) == [10**60 + 1]
