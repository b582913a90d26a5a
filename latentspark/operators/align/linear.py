"""Maps fitted from moments alone: orthogonal, least squares and canonical correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from latentspark.operators.align.base import Aligner, split_moment
from latentspark.operators.linalg import inverse_root, rank_for, relative_ridge, svd


def procrustes(xy: np.ndarray, xx_trace: float, scaling: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """(Q, scale, singular values) with y ~ scale * x Q': the polar factor of Y'X, square or not."""
    u, s, vt = svd(xy.T)
    return u @ vt, (float(s.sum() / max(xx_trace, 1e-300)) if scaling else 1.0), s


class ProcrustesAligner(Aligner):
    def __init__(self, scaling: bool = False, **chart) -> None:
        super().__init__(**chart)
        self.scaling = scaling

    def _fit_moments(self, moment: np.ndarray, d: int) -> None:
        m = split_moment(moment, d)
        self.q, self.scale, s = procrustes(m["xy"], np.trace(m["xx"]), self.scaling)
        self.explained = float(s.sum() / (m["n"] * min(self.q.shape)))
        # |Y - c X Q'|^2 from moments: without centring, as the map has no offset.
        mapped = self.q @ m["xx"] @ self.q.T
        self.r2 = float(1 - (np.trace(m["yy"]) - 2 * self.scale * s.sum() + self.scale**2 * np.trace(mapped)) / max(np.trace(m["yy"]), 1e-300))

    @property
    def regime(self) -> str:
        rows, columns = self.q.shape
        return "square" if rows == columns else "embedding" if rows > columns else "projection"

    def _map(self, z: np.ndarray) -> np.ndarray:
        return self.scale * z @ self.q.T


class LinearAligner(Aligner):
    """Ridge least squares of the charts as they are; orthogonalize replaces the matrix by its polar factor; the intercept is taken last, from the means."""

    def __init__(self, alpha: float = 1e-6, fit_intercept: bool = False, orthogonalize: bool = False, **chart) -> None:
        super().__init__(**chart)
        self.alpha, self.fit_intercept, self.orthogonalize = alpha, fit_intercept, orthogonalize

    def _fit_moments(self, moment: np.ndarray, d: int) -> None:
        m = split_moment(moment, d)
        n = m["n"]
        self.w = np.linalg.solve(relative_ridge(m["xx"], self.alpha), m["xy"])
        if self.orthogonalize:
            u, _, vt = svd(self.w)
            self.w = u @ vt
        self.b = (m["sy"] - m["sx"] @ self.w) / n if self.fit_intercept else np.zeros(self.w.shape[1])

    def _map(self, z: np.ndarray) -> np.ndarray:
        return z @ self.w + self.b

    @property
    def map_parameters(self) -> int:
        return self.w.size + (len(self.b) if self.fit_intercept else 0)


def canonical(cxx: np.ndarray, cxy: np.ndarray, cyy: np.ndarray, reg: float, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B, correlations): directions of x and y of largest correlation."""
    rx, ry = inverse_root(relative_ridge(cxx, reg)), inverse_root(relative_ridge(cyy, reg))
    u, s, vt = svd(rx @ cxy @ ry)
    k = min(len(s), k or len(s))
    return rx @ u[:, :k], ry @ vt.T[:, :k], np.clip(s[:k], 0, 1)


class CCAAligner(Aligner):
    """x to y over k canonical directions."""

    def __init__(self, n_canonical: int | None = None, reg: float = 1e-3, preprocess: str = "standard", **chart) -> None:
        super().__init__(preprocess=preprocess, **chart)
        self.n_canonical, self.reg = n_canonical, reg

    def _bases(self, d_x: int, d_y: int) -> tuple[np.ndarray, np.ndarray]:
        return np.eye(d_x), np.eye(d_y)

    def _fit_moments(self, moment: np.ndarray, d: int) -> None:
        m = split_moment(moment, d)
        n = m["n"]
        self.mx, self.my = m["sx"] / n, m["sy"] / n
        px, py = self._bases(len(self.mx), len(self.my))
        cxx, cxy, cyy = (m[c] / n - np.outer(a, b) for c, a, b in (("xx", self.mx, self.mx), ("xy", self.mx, self.my), ("yy", self.my, self.my)))
        a, b, self.correlations = canonical(px.T @ cxx @ px, px.T @ cxy @ py, py.T @ cyy @ py, self.reg, self.n_canonical)
        self.a, self.b = px @ a, np.linalg.pinv(b) @ py.T

    def _map(self, z: np.ndarray) -> np.ndarray:
        return (z - self.mx) @ self.a @ self.b + self.my

    @property
    def transmitted_symbols(self) -> int:
        return min(super().transmitted_symbols, self.a.shape[1])

    @property
    def map_parameters(self) -> int:
        return self.a.size + self.b.size


class SVCCAAligner(CCAAligner):
    """Each space is cut to its leading directions, found on the context, before CCA."""

    def __init__(self, svd_src: int | float = 0.99, svd_tgt: int | float = 0.99, **rest) -> None:
        super().__init__(**rest)
        self.svd_src, self.svd_tgt = svd_src, svd_tgt

    def fit(self, src: DataFrame, tgt: DataFrame, src_context: DataFrame | None = None, tgt_context: DataFrame | None = None) -> SVCCAAligner:
        self._contexts = (src if src_context is None else src_context, tgt if tgt_context is None else tgt_context)
        super().fit(src, tgt, src_context, tgt_context)
        del self._contexts
        return self

    def _bases(self, d_x: int, d_y: int) -> tuple[np.ndarray, np.ndarray]:
        from latentspark.operators.blocks import moment_matrix
        from latentspark.operators.spaces import covariance

        found = []
        for df, scaler, rank in zip(self._contexts, (self.src, self.tgt), (self.svd_src, self.svd_tgt), strict=True):
            _, cov = covariance(moment_matrix(scaler.transform(df.select("v")), "v"))
            values, basis = np.linalg.eigh(cov)
            found.append(basis[:, ::-1][:, : rank_for(np.maximum(values[::-1], 0), rank)])
        return found[0], found[1]
