"""Whitening against a dense eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidyward.llm.whitening import deviations, jacobi_davidson, minres, whiten


def falling(e, v):
    return e[::-1], v[:, ::-1]


@pytest.mark.parametrize("spectrum", ["spread", "cluster", "plain", "low rank"])
def test_eigenpairs_reach_double_precision(spectrum):
    r = np.random.default_rng(2)
    d = 300
    e = {"spread": np.linspace(1, 0, d) ** 6, "cluster": np.r_[np.ones(20), np.linspace(0, 0.99, d - 20)],
         "plain": 1 + 0.2 * r.random(d), "low rank": np.r_[3.0, 2.0, 1.0, np.zeros(d - 3)]}[spectrum]
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    k = 3 if spectrum == "low rank" else 16
    values, x = jacobi_davidson(lambda b: a @ b, d, k)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() < 1e-13 * e.max()
    assert np.linalg.norm(a @ x - x * values, axis=0).max() < 1e-13 * e.max()
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-13


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(3)
    a = np.diag(np.r_[np.linspace(-2, -1, 10), np.linspace(1, 3, 20)])
    b = r.normal(size=(30, 4))
    b[:, 3] = 0
    assert np.abs(a @ minres(lambda t: a @ t, b, 60, 1e-14) - b).max() < 1e-9


def plain(rows, k=16):
    """{(row, component): (n, deviation, whitened, explained)} by exact sums and ``eigh``."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda v: [float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]     # noqa: E731
    f = np.array([centre(v) for v in fit])
    cov = f.T @ f / n
    e, axes = falling(*np.linalg.eigh(cov))
    c = np.array([centre(v) for v in x])
    white = c @ axes[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, dev, white, e[:k] / np.trace(cov)


def test_equals_dense_whitening(spark):
    r = np.random.default_rng(4)
    rows = (r.normal(size=(400, 24)) * np.linspace(3, 0.5, 24)).tolist()
    rows += rows[:150] + [rows[0]] * 40
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(rows)],
                                  "vec_id bigint, embedding array<double>, n int, x int").repartition(5)
    got = whiten(table).collect()
    n, dev, white, explained = plain(rows)
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    out = np.zeros((len(rows), 16))
    for r in got:
        out[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == dev[r.vec_id] and abs(r.explained - explained[r.component - 1]) < 1e-12
    signs = np.sign((out * white).sum(0))
    assert np.abs(out * signs - white).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0]), (None, [5.0, 5.0]), (5, None), (6, []),
            (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf]), (10, [1.0, 2.0, 3.0]), (11, [1e300, -1e300])]
    schema = "vec_id bigint, embedding array<double>"
    got = whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted(
        (i, c) for i in (0, 1, 2, 3, 3, 11) for c in (1, 2) if any(r.component == c for r in got))
    normal = whiten(spark.createDataFrame(rows[:-1], schema)).collect()
    assert len(normal) == 10 and {r.n for r in normal} == {4}
    n, dev, white, _ = plain([v for _, v in rows[:5]])
    assert sorted(r.deviation for r in normal if r.component == 1) == sorted(dev)
    assert all(np.isfinite(r.whitened) for r in normal)
    for few in ([], rows[5:6], rows[:1], [rows[0], (2, rows[0][1])]):
        assert whiten(spark.createDataFrame(few, schema)).count() == 0
    # two distinct vectors: one component, however wide
    assert {r.component for r in whiten(spark.createDataFrame([(1, [1.0] * 30), (2, [2.0] * 30)], schema)).collect()} == {1}


def test_deviations_beyond_64_bits():
    d = np.array([[1 << 33, 0], [1, 2]])
    assert deviations(d, 5, [3, 4]) == [None, 2 ** 2 + 6 ** 2]
    assert deviations(np.array([[3, -4]]), 7, [0, 1]) == [21 ** 2 + 29 ** 2]
