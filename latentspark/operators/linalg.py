"""Small dense solves on the driver: all inputs are as large as vector widths or a capped pilot set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def fixed_signs(basis: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest magnitude is positive."""
    if not basis.size:
        return basis
    top = np.abs(basis).argmax(axis=0)
    return basis * np.where(basis[top, np.arange(basis.shape[1])] < 0, -1.0, 1.0)


def svd(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD; the eigenvectors of m'm step in where LAPACK does not converge."""
    if not np.isfinite(m).all():
        raise ValueError("matrix holds non-finite values")
    try:
        return np.linalg.svd(m, full_matrices=False)
    except np.linalg.LinAlgError:
        values, v = np.linalg.eigh(m.T @ m)
        v = v[:, ::-1]
        s = np.sqrt(np.maximum(values[::-1], 0))
        return m @ v / np.maximum(s, 1e-300), s, v.T


def inverse_root(cov: np.ndarray) -> np.ndarray:
    values, v = np.linalg.eigh(cov)
    return (v / np.sqrt(np.maximum(values, 1e-30))) @ v.T


def relative_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """gram plus alpha times its mean diagonal, at least 1e-30."""
    return gram + max(alpha * np.trace(gram) / len(gram), 1e-30) * np.eye(len(gram))


def rank_for(spectrum: np.ndarray, n_components: int | float | None) -> int:
    """An int is a rank; a float in (0, 1] a share of the spectrum's sum; None keeps all."""
    if n_components is None:
        return len(spectrum)
    if isinstance(n_components, bool):
        raise TypeError("a rank can't be a bool")
    if isinstance(n_components, float):
        if not 0 < n_components <= 1:
            raise ValueError("a share must be in (0, 1]")
        return min(len(spectrum), int(np.searchsorted(np.cumsum(spectrum) / max(spectrum.sum(), 1e-300), n_components)) + 1)
    if n_components < 1:
        raise ValueError("a rank must be at least 1")
    return min(len(spectrum), n_components)


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row of a square cost matrix at least total cost, by shortest augmenting paths."""
    n = len(cost)
    row_of, price_row, price_col = np.full(n + 1, n), np.zeros(n + 1), np.zeros(n + 1)
    for row in range(n):
        row_of[n], at = row, n
        slack, came, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] != n:
            done[at] = True
            r = row_of[at]
            reduced = cost[r] - price_row[r] - price_col[:n]
            better = ~done[:n] & (reduced < slack)
            slack[better], came[better] = reduced[better], at
            open_slack = np.where(done[:n], np.inf, slack)
            nxt = int(open_slack.argmin())
            step = open_slack[nxt]
            price_row[row_of[done]] += step
            price_col[done] -= step
            slack[~done[:n]] -= step
            at = nxt
        while at != n:
            row_of[at] = row_of[came[at]]
            at = came[at]
    out = np.zeros(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def quadratic_assignment(a: np.ndarray, b: np.ndarray, fixed: int = 0, rounds: int = 30) -> np.ndarray:
    """Permutation p that makes <a, b[p][:, p]> large, by Frank-Wolfe steps over assignments; the first ``fixed`` places map to themselves."""
    n = len(a)
    p = np.full((n, n), 0.0)
    p[:fixed, :fixed] = np.eye(fixed)
    if n > fixed:
        p[fixed:, fixed:] = 1.0 / (n - fixed)

    def rounded(score: np.ndarray) -> np.ndarray:
        q = np.eye(n)
        if n > fixed:
            q[fixed:, fixed:] = np.eye(n - fixed)[assignment(-score[fixed:, fixed:])]
        return q

    for _ in range(rounds):
        gradient = a @ p @ b.T + a.T @ p @ b
        q = rounded(gradient)
        step = q - p
        quadratic, linear = np.sum((a @ step) * (step @ b)), np.sum((a @ p) * (step @ b)) + np.sum((a @ step) * (p @ b))
        if linear <= 1e-12 and quadratic <= 0:
            break
        t = 1.0 if quadratic >= 0 else min(1.0, -linear / (2 * quadratic))
        p = p + t * step
        if t * np.abs(step).max() < 1e-9:
            break
    return rounded(p).argmax(axis=1)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 200, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Minimum of f, which returns value and gradient, by limited-memory quasi-Newton steps with backtracking."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            break
        q, weights = g.copy(), []
        for s, y in reversed(past):
            w = s @ q / (s @ y)
            weights.append(w)
            q -= w * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), w in zip(past, reversed(weights), strict=True):
            q += s * (w - y @ q / (s @ y))
        slope, t = -(q @ g), 1.0 if past else min(1.0, 1.0 / np.abs(g).sum())
        if slope >= 0:
            q, slope = g, -(g @ g)
        while True:
            new_value, new_g = f(x - t * q)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
            if t < 1e-14:
                return x
        s, y = -t * q, new_g - g
        x, value, g = x + s, new_value, new_g
        if s @ y > 1e-12 * (y @ y):
            past = [*past[-(memory - 1) :], (s, y)]
    return x
