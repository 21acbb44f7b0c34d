"""Leading eigenvalues and eigenvectors of a symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)

#: Eigenvalues closer than this share of the largest absolute value form a cluster, whose vectors are kept orthogonal to each other.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, beside, basis`` with ``matrix = basis @ T @ basis.T`` for the tridiagonal T, by Householder reflections."""
    a = np.array(matrix, np.float64)
    n = len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1:, k + 1:]
        w = block @ v
        w -= (v @ w) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        basis[:, k + 1:] -= 2 * np.outer(basis[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def counts_below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: the negative pivots of the shifted matrix."""
    least = _EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(beside).max(initial=0)), np.finfo(np.float64).tiny) ** 2
    squares = np.concatenate([[0.0], beside * beside])
    pivot, below = np.ones_like(at), np.zeros(len(at), np.int64)
    for d, s in zip(diagonal, squares):
        pivot = d - at - s / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected on Sturm counts until no double lies between its bounds."""
    n = len(diagonal)
    radius = np.abs(np.append(beside, 0)) + np.abs(np.insert(beside, 0, 0))
    margin = 4 * _EPS * (np.abs(diagonal) + radius).max()
    low = np.full(k, (diagonal - radius).min() - margin)
    high = np.full(k, (diagonal + radius).max() + margin)
    place = n - 1 - np.arange(k)  # as many eigenvalues lie below
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = counts_below(diagonal, beside, middle) <= place
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _factored(diagonal: np.ndarray, beside: np.ndarray, shift: float, least: float) -> tuple:
    """The tridiagonal matrix less ``shift`` as an upper triangle of three diagonals, with the row exchanges and multipliers."""
    n = len(diagonal)
    main, one, two = diagonal - shift, np.append(beside, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        under, next_main, next_one = beside[i], main[i + 1], one[i + 1]
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            main[i], one[i], two[i], rest, rest_one = under, next_main, next_one, one[i], 0.0
            main[i + 1], one[i + 1] = rest - factor[i] * one[i], rest_one - factor[i] * two[i]
        else:
            factor[i] = under / main[i] if main[i] else 0.0
            main[i + 1] = next_main - factor[i] * one[i]
    return np.where(np.abs(main) < least, np.copysign(least, main), main), one, two, factor, swapped


def _solved(parts: tuple, x: np.ndarray) -> np.ndarray:
    main, one, two, factor, swapped = parts
    x, n = x.copy(), len(x)
    for i in range(n - 1):
        if swapped[i]:
            x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
        else:
            x[i + 1] -= factor[i] * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (one[i] * x[i + 1] if i + 1 < n else 0.0) - (two[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / main[i]
        if abs(x[i]) > 1e200:
            x /= abs(x[i])
    return x


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``values, vectors``: the ``k`` largest eigenvalues, falling, and unit eigenvectors as rows.

    Each vector comes from inverse iteration on the tridiagonal form at its eigenvalue; inside a cluster every step takes out the parts along the
    cluster's earlier vectors, so that equal eigenvalues get an orthonormal set. The starts are fixed, so runs agree.
    The sign makes the entry of greatest absolute value positive.
    """
    scale = float(np.abs(matrix).max(initial=0))
    k = min(k, len(matrix))
    if scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, beside, basis = tridiagonal(matrix / scale)
    values = leading_values(diagonal, beside, k)
    size = max(float(np.abs(diagonal).max()), float(np.abs(beside).max(initial=0)))
    draws, found, head = np.random.default_rng(5), [], 0
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * size:
            head = i
        parts = _factored(diagonal, beside, values[i], _EPS * size)
        x = draws.standard_normal(len(diagonal))
        for _ in range(5):
            for _ in range(2):
                for other in found[head:]:
                    x -= (other @ x) * other
            x = _solved(parts, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
        for _ in range(2):
            for other in found[head:]:
                x -= (other @ x) * other
        found.append(x / np.linalg.norm(x))
    vectors = np.array(found) @ basis.T
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    top = vectors[np.arange(k), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)[:, None]
