"""Whitening against numpy's decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import whitening

ROWS = "vec_id long, embedding array<double>, n long, component int, x string"


def triangle(a):
    return np.linalg.qr(np.vstack([a, np.zeros((a.shape[1],) * 2)]), mode="r")


def matrices():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(40, 10)))[0]
    near = q @ np.diag([5, 5, 5, 4.99999999, 3, 3, 1, 1e-9, 0, 0]) @ np.linalg.qr(rng.normal(size=(10, 10)))[0]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 1e-3) + np.diag(np.ones(20), 1)
    return {"normal": rng.normal(size=(300, 64)), "graded": rng.normal(size=(300, 32)) * 10.0 ** -np.arange(0, 16, 0.5), "rank 3": rng.normal(size=(3, 20)), "identity": np.eye(8), "zero": np.zeros((4, 5)), "equal": np.ones((5, 6)), "orthonormal": q, "repeated columns": np.hstack([rng.normal(size=(50, 3))] * 2), "clusters": near, "wilkinson": wilkinson, "one": rng.normal(size=(9, 1)), "two": rng.normal(size=(9, 2))}


@pytest.mark.parametrize("name", sorted(matrices()))
def test_solver(name):
    a = matrices()[name]
    d = a.shape[1]
    wanted = np.zeros(d)
    got = np.linalg.svd(a, compute_uv=False)
    wanted[: len(got)] = got
    scale = max(wanted[0], 1e-300)
    diagonal, above, back = whitening.bidiagonal(triangle(a))
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.abs(back @ b.T @ b @ back.T - a.T @ a).max() <= 1e-13 * max(1, scale**2) * d
    assert np.abs(np.sqrt(whitening.squared_singular_values(diagonal, above)) - wanted).max() <= 1e-14 * scale
    values, vectors = whitening.directions(triangle(a), d)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-13 * scale**2


def test_small_values_are_accurate():
    """A bidiagonal of tiny and large entries, whose values are known to high relative accuracy."""
    diagonal, above = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1.0, 1e-4, 1e-8])
    from fractions import Fraction as Q

    got = np.sqrt(whitening.squared_singular_values(diagonal, above))
    product = Q(1)
    for v in got:
        product *= Q(float(v))
    wanted = Q(1)
    for v in diagonal:
        wanted *= Q(float(v))
    assert abs(float(product / wanted) - 1) < 1e-14  # the determinant, though the least is 1e-13 of the largest


def plain(rows, components):
    """(id, n, deviation, whitened, explained) by numpy on the distinct whole vectors."""
    x = np.array([r[1] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_whitened(spark, parts):
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=6) * [3, 2.5, 2, 1.5, 1, 0.5]).tolist()) for i in range(300)]
    data += [(400 + i, data[0][1]) for i in range(100)] + [(7, data[7][1]), (500, [1.0, -2.0])]  # a hot vector, a repeated row, a short vector
    odd = [(600, None), (601, [1.0, None]), (602, [float("nan")]), (603, [float("-inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1, 1, "clash") for r in data + odd], ROWS).repartition(parts)
    got = whitening.whitened(df, 4).toPandas()
    whole = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v)))).astype(int)) for i, v in data]
    n, deviation, w, explained = plain(whole, 4)
    assert len(got) == 4 * len(data) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    by_id = {i: k for k, (i, _) in enumerate(whole)}
    for k in range(4):
        own = got[got.component == k + 1]
        at = [by_id[i] for i in own.vec_id]
        assert (own.deviation.to_numpy() == deviation[at]).all() and np.allclose(own.explained, explained[k], rtol=1e-12)
        sign = np.sign((own.whitened * w[at, k]).sum())
        assert np.allclose(sign * own.whitened, w[at, k], atol=1e-9)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, 1, "c") for r in rows], ROWS)
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    assert whitening.whitened(make([(1, []), (2, [])])).count() == 0
    line = whitening.whitened(make([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [3.0, 6.0])])).toPandas()
    assert sorted(line.component) == [1, 1, 1] and line.vec_id.isna().sum() == 1 and np.allclose(line.explained, 1)  # one direction varies
    big = whitening.whitened(make([(1, [2.0**21]), (2, [-(2.0**21)]), (3, [0.0])])).toPandas()
    assert set(big.deviation) == {(3 * 2**29) ** 2, 0}
    with pytest.raises(Exception, match="exceeds a long"):
        whitening.whitened(make([(1, [2.0**40]), (2, [-(2.0**40)]), (3, [0.0])])).collect()
    with pytest.raises(Exception, match="exceeds a long"):
        whitening.whitened(make([(1, [2.0**60]), (2, [0.0])])).collect()


def test_triangles_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(8)
    x = rng.integers(-100, 100, (500, 5))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(11)
    found = whitening.Whitening(len(x), 5, np.array([int(s) for s in x.sum(0)], object), np.zeros(0), np.zeros((5, 0)), 0.0, False)
    r = whitening.triangle(fit, found)
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12, atol=1e-6) and r.shape == (5, 5)


def test_identity_error_is_measured(spark):
    """A wrong direction shows."""
    rng = np.random.default_rng(2)
    x = rng.integers(-100, 100, (200, 3))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(3)
    found = whitening.Whitening(len(x), 3, np.array([int(s) for s in x.sum(0)], object), np.array([1000.0, 1000.0]), np.eye(3)[:, :2], 1.0, False)
    w = (x - x.mean(0))[:, :2] / np.sqrt(1000.0)
    assert whitening.identity_error(fit, found) == pytest.approx(np.abs(np.cov(w.T, bias=True) - np.eye(2)).max())
    assert fit.select(F.size("x")).distinct().count() == 1
