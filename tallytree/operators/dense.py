"""A small dense kernel in numpy; callers bound its size."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, c: np.ndarray, tolerance: float = 1e-10, rounds: int | None = None) -> np.ndarray:
    """The x >= 0 with the least x'ax / 2 - c'x for positive definite a, by an active-set search."""
    n = len(c)
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(c).max(initial=0)))
    for _ in range(rounds or 10 * n + 10):
        slope = c - a @ x
        if free.all() or (slope[~free] <= tolerance * scale).all():
            return x
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.solve(a[np.ix_(free, free)], c[free])
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            step = (x[low] / np.where(x[low] - s[low] == 0, 1, x[low] - s[low])).min()
            x = x + step * (s - x)
            free &= x > tolerance
            x[~free] = 0
    raise ValueError("Non-negative least squares have not converged; the matrix may be ill-conditioned.")
