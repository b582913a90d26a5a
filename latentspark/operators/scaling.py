"""Invertible charts of a space, fitted from distributed moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.operators.blocks import cut_lineage, map_vectors, matrix, moment_matrix
from latentspark.operators.linalg import fixed_signs, rank_for
from latentspark.operators.spaces import covariance

METHODS = ("none", "center", "standard", "pca", "pga", "whiten")
FLOOR = 1e-10


def r_factor(df: DataFrame, mean: np.ndarray, vector: str = "v") -> np.ndarray:
    """R of a QR of the centred rows: one R for each task, and one of those stacked (they are width x width)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v")) - mean
                r = np.linalg.qr(x if r is None else np.concatenate([r, x]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial, "r binary").collect()
    return np.linalg.qr(np.concatenate([np.frombuffer(x.r).reshape(-1, len(mean)) for x in rows]), mode="r")


def ledoit_wolf(cov: np.ndarray, n: float, fourth: float) -> float:
    """Shrinkage toward the scaled identity from the covariance and the sum of fourth powers of row norms."""
    d, mu = len(cov), np.trace(cov) / len(cov)
    delta = (np.sum(cov**2) - d * mu**2) / d
    beta = min((fourth / n - np.sum(cov**2)) / (d * n), delta)
    return 0.0 if beta <= 0 or delta <= 0 else float(beta / delta)


def sphere_log(mu: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Tangent vectors at mu of points on the unit sphere; mu itself maps to 0."""
    c = np.clip(x @ mu, -1.0, 1.0)
    off = x - c[:, None] * mu
    size = np.linalg.norm(off, axis=1)
    return off * np.where(size > 1e-15, np.arccos(c) / np.maximum(size, 1e-15), 0.0)[:, None]


def sphere_exp(mu: np.ndarray, t: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(t, axis=1, keepdims=True)
    out = np.cos(angle) * mu + np.where(angle > 1e-15, np.sin(angle) / np.maximum(angle, 1e-15), 1.0) * t
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def frechet_mean(df: DataFrame, vector: str = "v", rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Karcher mean of the rows' directions; each round is one distributed sum of log maps, a row for each task."""
    units = cut_lineage(map_vectors(df.select(vector), _units, vector))

    def mean_of(apply) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "s": [apply(matrix(batch.column(vector))).sum(axis=0)]})

        parts = units.mapInArrow(partial, "n long, s array<double>").collect()
        return np.sum([r.s for r in parts], axis=0) / sum(r.n for r in parts)

    mu = mean_of(lambda x: x)
    mu = mu / max(np.linalg.norm(mu), 1e-300)
    for _ in range(rounds):
        step = mean_of(lambda x, mu=mu: sphere_log(mu, x))
        mu = sphere_exp(mu, step[None])[0]
        if np.linalg.norm(step) < tolerance:
            break
    return mu


class Scaler:
    """Chart of a space. ``n_components``: int rank, float share of variance, None all; shrinkage: a share or 'auto'."""

    def __init__(self, method: str = "whiten", n_components: int | float | None = None, shrinkage: float | str = 0.0) -> None:
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        self.method, self.n_components, self.shrinkage = method, n_components, shrinkage
        self.mean: np.ndarray | None = None
        self.pole: np.ndarray | None = None

    def fit(self, df: DataFrame, vector: str = "v") -> Scaler:
        if self.method == "pga":
            self.pole = frechet_mean(df, vector)
            self.radius = float(df.select(F.avg(vec.norm(F.col(vector)))).first()[0])
            df = map_vectors(df.select(vector), self._tangent, vector)
        moment = moment_matrix(df, vector)
        n = moment[0, 0]
        self.mean, cov = covariance(moment)
        d = len(self.mean)
        if self.method == "none":
            self.mean = np.zeros(d)
        share = self.shrinkage
        if share == "auto":
            mean = F.array(*[F.lit(float(x)) for x in self.mean])
            fourth = df.select(F.sum(F.pow(vec.sq_dist(F.col(vector).cast("array<double>"), mean), 2))).first()[0]
            share = ledoit_wolf(cov, n, fourth)
        self.forward = self.backward = np.eye(d)
        if self.method == "standard":
            std = np.sqrt(np.maximum(np.diag(cov), 0))
            std[std <= 0] = 1.0
            self.forward, self.backward = np.diag(1 / std), np.diag(std)
        elif self.method in ("pca", "pga", "whiten"):
            if share:
                values, basis = np.linalg.eigh((1 - share) * cov + share * np.trace(cov) / d * np.eye(d))
                values, basis = np.maximum(values[::-1], 0), basis[:, ::-1]
            else:  # by QR, as squaring the rows would lose the small directions
                _, s, vt = np.linalg.svd(r_factor(df, self.mean, vector))
                values, basis = np.zeros(d), vt.T
                values[: len(s)] = s**2 / n
            basis = fixed_signs(basis)
            if self.method == "whiten":
                values = np.maximum(values, FLOOR)
            k = rank_for(values, self.n_components)
            basis, root = basis[:, :k], np.sqrt(values[:k])
            self.forward, self.backward = basis, basis.T
            if self.method == "whiten":
                self.forward, self.backward = basis / root, root[:, None] * basis.T
                if k == d:
                    self.forward, self.backward = (basis / root) @ basis.T, (basis * root) @ basis.T
        return self

    def _tangent(self, x: np.ndarray) -> np.ndarray:
        return sphere_log(self.pole, _units(x))

    @property
    def out_dim(self) -> int:
        return self.forward.shape[1]

    @property
    def is_invertible(self) -> bool:
        return self.method != "pga" and self.out_dim == len(self.mean)

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            raise RuntimeError("the scaler is not fitted")
        if x.shape[1] != len(self.mean):
            raise ValueError(f"width {x.shape[1]} is not {len(self.mean)}")
        return ((self._tangent(x) if self.pole is not None else x) - self.mean) @ self.forward

    def invert(self, z: np.ndarray) -> np.ndarray:
        x = z @ self.backward + self.mean
        return self.radius * sphere_exp(self.pole, x) if self.pole is not None else x

    def transform(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return map_vectors(df, self.apply, vector, vector)
