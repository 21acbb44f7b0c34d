from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from panelspark.llm.queries import QUERIES
from panelspark.llm.spectral import counts_below, leading_components, tridiagonal
from panelspark.llm.whitening import whiten

from .rows import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 40):
        a = rng.standard_normal((n, 2 * n))
        yield a @ a.T
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    for values in ([5.0] * 6 + [1.0] * 6, [3, 3, 3, 2, 2, 1, 1, 1, 0, 0, 0, 0], [1 + 1e-9 * i for i in range(12)], [10.0**-i for i in range(12)]):
        yield (q * np.array(values, float)) @ q.T
    yield np.diag(np.arange(9.0))
    yield np.ones((6, 6))
    yield np.zeros((4, 4))


@pytest.mark.parametrize("k", [3, 40])
def test_components_are_orthonormal_eigenvectors(k):
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = leading_components(a, k)
        scale = max(float(np.abs(a).max()), 1e-300)
        want = np.linalg.eigvalsh(a)[::-1][:k]
        assert np.abs(values - want).max() <= 1e-13 * len(a) * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 1e-13 * len(a) * scale


def test_sturm_counts():
    a = np.random.default_rng(1).standard_normal((20, 20))
    d, e, q = tridiagonal(a + a.T)
    assert np.abs(q @ (np.diag(d) + np.diag(e, 1) + np.diag(e, -1)) @ q.T - a - a.T).max() < 1e-12
    values = np.linalg.eigvalsh(a + a.T)
    at = np.linspace(-15, 15, 50)
    assert counts_below(d, e, at).tolist() == [int((values < x).sum()) for x in at]


def check(got, rows, k=32):
    """All facts against exact fractions and numpy's eigenvalues."""
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for _, v in x])
    cov = y.T @ y / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    white = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in x])
    for i, v in x:
        assert {r.deviation for r in by[i].values()} == {sum((n * c - s) ** 2 for c, s in zip(v, sums))}
    for c in range(1, k + 1):
        assert by[x[0][0]][c].explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
    error = np.abs(white.T @ white / n - np.eye(k)).max()
    assert error < 1e-8 and {r.identity_error < 1e-8 for r in got} == {True}
    # whitened = Y w / sqrt(e) for an eigenvector w of the covariance
    w = np.linalg.lstsq(y, white * np.sqrt(values[:k]), rcond=None)[0]
    assert np.abs(y @ w - white * np.sqrt(values[:k])).max() < 1e-8
    assert np.abs(cov @ w - w * values[:k]).max() < 1e-8 * max(1.0, values[0])


def test_registered_query(spark):
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    check(got, [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()])


def test_large_entries_and_ties(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((60, 5)) * [2e3, 1e2, 1, 1, 1]
    vectors[:, 4] = vectors[:, 3]  # no variance along their difference
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vectors)]
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    check(whiten(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)).collect(), rows)


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0], 0), (None, [3.0, -2.0], 0), (1, [0.5, 9.0], 0), (1, [0.5, 9.0], None)]
    bad = [(5, None, 0), (6, [], 0), (7, [1.0, None], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (10, [1.0, 2.0, 3.0], 0)]
    clash = spark.createDataFrame([(*r, 1, 2) for r in good + bad], SCHEMA + ", n int, component int")
    got = whiten(clash).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1"] * 6 + ["None"] * 2) and {r.n for r in got} == {4}
    for rows in ([], bad[:5], [good[0]], [good[0]] * 3):
        assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    huge = [(1, [3e38], 0), (2, [-3e38], 0), (3, [1.0], 0)]
    assert {r.deviation for r in whiten(spark.createDataFrame(huge, SCHEMA)).collect()} >= {None}
