"""Kernels: as columns over a pair of vectors, and as blocks in numpy."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.functions import vec

#: Rows over which the median bandwidth is taken; larger pools are sampled by hash of the id.
MEDIAN_ROWS = 2000
#: Rows of either side of a kernel block that are worked on at a time, so that what is in between stays in a core's cache.
CACHE_ROWS, CACHE_COLUMNS = 64, 1024


def sq_dists(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    d = np.matmul(-2.0 * a, b.T, out=out)
    d += np.einsum("nd,nd->n", a, a)[:, None]
    d += np.einsum("md,md->m", b, b)
    return np.maximum(d, 0.0, out=d)


@dataclass(frozen=True)
class Kernel:
    """rbf exp(-g d^2), laplacian exp(-g d), polynomial (xy + c)^p, linear xy, cosine; g None: from the median."""

    name: str = "rbf"
    gamma: float | None = None
    scale: float = 1.0
    degree: int = 3
    coef0: float = 1.0

    def __post_init__(self) -> None:
        if self.name not in ("rbf", "laplacian", "polynomial", "linear", "cosine"):
            raise ValueError(f"unknown kernel {self.name!r}")
        if self.name == "polynomial" and self.coef0 < 0:
            raise ValueError("coef0 must be at least 0")

    def fitted(self, median: float) -> Kernel:
        """With gamma set from a median squared distance, if it isn't set and the kernel has one."""
        if self.gamma is not None or self.name not in ("rbf", "laplacian"):
            return self
        return replace(self, gamma=1.0 / (self.scale * (median if self.name == "rbf" else np.sqrt(median))))

    def spec(self) -> dict[str, object]:
        """The settings that make the same unfitted kernel again; those that its name doesn't use are left out."""
        used = {"rbf": ("gamma", "scale"), "laplacian": ("gamma", "scale"), "polynomial": ("degree", "coef0")}.get(self.name, ())
        return {"name": self.name} | {k: getattr(self, k) for k in used}

    def summary(self) -> dict[str, object]:
        """Flat values for a record."""
        return {f"kernel_{k}": v for k, v in self.spec().items() if v is not None}

    def block(self, a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Cells of all pairs, in ``out`` if there is one. Nothing else as large is made, as fresh memory costs more than a cell's work."""
        out = np.empty((len(a), len(b))) if out is None else out
        if self.name in ("rbf", "laplacian"):  # products of [-2a, a'a, 1] and [b, 1, b'b] are squared distances
            scale = -self.gamma if self.name == "rbf" else 1.0
            a = scale * np.concatenate([-2.0 * a, np.einsum("nd,nd->n", a, a)[:, None], np.ones((len(a), 1))], axis=1)
            b = np.concatenate([b, np.ones((len(b), 1)), np.einsum("md,md->m", b, b)[:, None]], axis=1)
        if self.name == "cosine":
            a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.TINY) for x in (a, b))
        for j in range(0, len(b), CACHE_COLUMNS):
            for i in range(0, len(a), CACHE_ROWS):
                k = out[i : i + CACHE_ROWS, j : j + CACHE_COLUMNS]
                np.matmul(a[i : i + CACHE_ROWS], b[j : j + CACHE_COLUMNS].T, out=k)
                self._bend(k)
        return out

    def _bend(self, k: np.ndarray) -> None:
        """Products to kernel values, in place."""
        if self.name == "rbf":
            np.exp(np.minimum(k, 0.0, out=k), out=k)
        elif self.name == "laplacian":
            np.sqrt(np.maximum(k, 0.0, out=k), out=k)
            k *= -self.gamma
            np.exp(k, out=k)
        elif self.name == "polynomial":
            k += self.coef0
            np.power(k, self.degree, out=k)

    def column(self, a: Column, b: Column) -> Column:
        if self.name == "rbf":
            return F.exp(-F.lit(self.gamma) * vec.sq_dist(a, b))
        if self.name == "laplacian":
            return F.exp(-F.lit(self.gamma) * F.sqrt(vec.sq_dist(a, b)))
        if self.name == "cosine":
            return vec.cosine(a, b)
        k = vec.dot(a, b)
        return F.pow(k + self.coef0, self.degree) if self.name == "polynomial" else k


def by_hash(df: DataFrame, seed: int = 0, id_column: str = "sample_id") -> Column:
    """A reproducible order that SQL can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))


def rule_of_thumb_gamma(x: np.ndarray, scale: float = 1.0) -> float:
    """Inverse width 1 / (2 s^2) with s^2 ten times the mean column variance, times scale."""
    return 1.0 / (2.0 * scale * 10.0 * max(float(np.var(x, axis=0).mean()), 1e-30))


def median_of(x: np.ndarray) -> float:
    """Median squared distance of distinct rows; 1 where there is none or it is 0."""
    if len(x) < 2:
        return 1.0
    median = float(np.median(sq_dists(x, x)[np.triu_indices(len(x), 1)]))
    return median if median > 0 else 1.0


def median_sq_dist(df: DataFrame, vector: str = "v", id_column: str = "sample_id", rows: int = MEDIAN_ROWS) -> float:
    """median_of the first ``rows`` vectors by hash; that bound is what reaches the driver."""
    some = df.select(F.col(vector).cast("array<double>").alias("v"), id_column).orderBy(by_hash(df, 0, id_column), id_column).limit(rows)
    found = [r.v for r in some.collect()]
    return median_of(np.array(found)) if found else 1.0
