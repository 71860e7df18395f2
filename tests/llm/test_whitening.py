"""Whitening against exact sums and a solver of its own, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.whitening import DoubleDouble

VEC = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def exact_covariance(x):
    """n^2 times the covariance, in whole numbers."""
    x = np.array(x, dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = x * n - s
    return z.T.dot(z), n


def jacobi(a):
    """Eigenvalues and vectors by Jacobi rotations in long doubles: another method, for comparison."""
    a, q = a.astype(np.longdouble), np.eye(len(a), dtype=np.longdouble)
    for _ in range(60):
        off = np.abs(a - np.diag(a.diagonal()))
        if off.max() <= 1e-30 * np.abs(a).max():
            break
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if a[i, j] == 0:
                    continue
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                g = np.eye(len(a), dtype=np.longdouble)
                g[i, i] = g[j, j] = c
                g[i, j], g[j, i] = c * t, -c * t
                a, q = g.T @ a @ g, q @ g
    order = np.argsort(-a.diagonal())
    return a.diagonal()[order], q[:, order]


def test_products_are_exact_to_double_double():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1300, 7)) * 10.0 ** rng.integers(-9, 9, 7)
    got = DoubleDouble.zero(7, 7).add_product(a[:600], a[:600]).add_product(a[600:], a[600:]).settled()
    for i in range(7):
        for j in range(7):
            want = sum(Fraction(x) * Fraction(y) for x, y in zip(a[:, i], a[:, j]))
            size = sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(a[:, i], a[:, j]))
            assert abs(Fraction(got.high[i, j]) + Fraction(got.low[i, j]) - want) <= size * Fraction(2) ** -95


def test_eigen_solve_is_good_to_double_precision():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    for spectrum in (np.arange(1.0, 13), np.repeat([5.0, 2.0, 1.0], 4), 10.0 ** -np.arange(12.0), np.zeros(12)):
        v = (basis * spectrum) @ basis.T
        v = (v + v.T) / 2
        values, q = whitening.eigen(DoubleDouble(v, np.zeros_like(v)))
        want, _ = jacobi(v)
        assert np.abs(q.T @ q - np.eye(12)).max() < 1e-14
        assert np.abs(v @ q - q * values).max() <= 1e-14 * max(1, spectrum.max())
        assert np.abs(values - want.astype(float)).max() <= 1e-15 * max(spectrum.max(), 1)


def planted(rng, n, d):
    rows = (rng.normal(size=(n, d)) * np.linspace(1, 0.01, d) * 8 + rng.normal(size=d)).astype(np.float32)
    return [(i, [float(c) for c in v], int(i % 3)) for i, v in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_matches_exact_sums(spark, monkeypatch, parts):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = planted(np.random.default_rng(3), 700, 9)
    bad = [(1000, None, 0), (1001, [1.0, None] + [0.0] * 7, 0), (1002, [float("nan")] * 9, 0), (1003, [float("inf")] * 9, 1), (1004, [], 1)]
    frame = spark.createDataFrame(rows + bad + rows[:1], VEC).repartition(parts)
    kept = rows + rows[:1]
    got, w = whitening.whiten(frame, components=32)
    got = got.selectExpr("vec_id", f"{w}.*").collect()
    assert sorted(r.vec_id for r in got) == sorted(r[0] for r in kept)
    x = {i: [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for i, v, _ in kept}
    scaled, n = exact_covariance([x[i] for i, _, _ in kept])
    sums = [sum(x[i][k] for i, _, _ in kept) for k in range(9)]
    v = np.array([[float(Fraction(int(c), n**3)) for c in line] for line in scaled])
    values, q = jacobi(v)
    by = {r.vec_id: r for r in got}
    for i, r in by.items():
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x[i], sums)])
        assert np.allclose(np.abs(r["values"]), np.abs(z @ q / np.sqrt(values)).astype(float), rtol=1e-9, atol=1e-9)
        assert np.allclose(r.explained, (values / np.trace(v)).astype(float), rtol=1e-10)
        assert r.identity_error < 1e-10
    white = np.array([by[i]["values"] for i, _, _ in kept])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(9)).max() < 1e-10


def test_odd_vectors(spark):
    got, _ = whitening.whiten(spark.createDataFrame([], VEC))
    assert got.count() == 0
    # one vector, equal vectors, a dimension that says nothing, two lengths, clashing names, null ids
    frame = spark.createDataFrame([(None, [1.0, 2.0], 1, 5, 6), (7, [1.0, 2.0], 1, 5, 6), (1, [0.0, 1.0, 2.0], 0, 1, 2), (2, [1.0, 1.0, 4.0], 0, 3, 4), (3, [2.0, 1.0, -1.0], 0, 5, 6)], "vec_id long, embedding array<double>, label int, x int, whitened int")
    got, w = whitening.whiten(frame)
    assert w not in frame.columns and got.columns[:-1] == frame.columns
    rows = got.selectExpr("vec_id", "x AS kept", f"{w}.*").collect()
    assert len(rows) == 5
    for r in rows:
        if r.vec_id in (None, 7):
            assert (r.n, r.deviation, r["values"], r.explained, r.identity_error) == (2, 0, [None, None], [None, None], None)
        else:
            assert r.n == 3 and r["values"][2] is None and all(v is not None for v in r["values"][:2]) and r.explained[2] < 1e-12 and r.identity_error < 1e-12
    # entries too large for doubles to tell apart go, large ones that are not do not
    got, w = whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1e13]), (3, [-1e13]), (4, [0.0])], "vec_id long, embedding array<double>"))
    rows = {r.vec_id: r for r in got.selectExpr("vec_id", f"{w}.*").collect()}
    assert set(rows) == {2, 3, 4} and rows[4].deviation == 0 and rows[2].deviation is None and abs(rows[2]["values"][0] ** 2 - 1.5) < 1e-12


def test_query_covers_the_whole_table(spark):
    got = whitening.op11_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 500 * 32 and {r.n for r in rows} == {500} and max(r.identity_error for r in rows) < 1e-9
    first = {r.component: r.explained for r in rows if r.vec_id == 0}
    assert sorted(first) == list(range(1, 33)) and all(first[k] >= first[k + 1] for k in range(1, 32))
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.array([np.floor(64 * np.array(v, dtype=float)) for v in table.values()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose([first[k] for k in range(1, 33)], values[:32] / values.sum(), rtol=1e-9)
