"""Integer number-theoretic transforms over columns of an array, modulo a prime below 2^30."""

from __future__ import annotations

from functools import cache

import numpy as np

#: 119 * 2^23 + 1; 3 generates its units. Transforms go up to 2^23 points.
PRIME = 998244353
_GENERATOR = 3
_P = np.uint64(PRIME)


def remainder(a: np.ndarray) -> np.ndarray:
    """``a`` modulo the prime; numpy divides by a constant much faster than it takes remainders."""
    return a - a // _P * _P


@cache
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``, as a column."""
    root = pow(_GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(half, np.uint64)
    known = 1
    while known < half:
        step = np.uint64(pow(root, known, PRIME))
        more = min(known, half - known)
        powers[known:known + more] = remainder(powers[:more] * step)
        known += more
    return powers[:, None]


def forward(a: np.ndarray) -> np.ndarray:
    """The transform of every column of ``a`` (points x columns, below the prime), in bit-reversed order; ``a`` is used up."""
    points, columns = a.shape
    half = points // 2
    while half:
        v = a.reshape(-1, 2, half, columns)
        low, high = v[:, 0], v[:, 1]
        total = low + high
        gap = remainder((low + (_P - high)) * _roots(half, False))
        v[:, 0] = np.minimum(total, total - _P)  # an unsigned difference below zero wraps and is the larger one
        v[:, 1] = gap
        half //= 2
    return a


def backward(a: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``, from its bit-reversed order; ``a`` is used up."""
    points, columns = a.shape
    half = 1
    while half < points:
        v = a.reshape(-1, 2, half, columns)
        low = v[:, 0].copy()
        high = remainder(v[:, 1] * _roots(half, True))
        total, gap = low + high, low + (_P - high)
        v[:, 0] = np.minimum(total, total - _P)
        v[:, 1] = np.minimum(gap, gap - _P)
        half *= 2
    return remainder(a * np.uint64(pow(points, -1, PRIME)))
