"""Maps through kernels of the pilots: a constrained residual on a rigid map, kernel CCA, and kernel alignment rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions.kernels import MEDIAN_ROWS, Kernel, median_of, rule_of_thumb_gamma, sq_dists
from latentspark.operators.align.anchors import drawn_pairs, lloyd, medoid_pairs, pairs_of, table_clusters
from latentspark.operators.align.base import Aligner
from latentspark.operators.align.krylov import BasisTooWide, DistributedGram, KrylovSolver, kernel_product
from latentspark.operators.align.linear import canonical, procrustes
from latentspark.operators.auction import assign
from latentspark.operators.blocks import cut_lineage, made_moment, map_vectors, matrix
from latentspark.operators.linalg import assignment, quadratic_assignment, rank_for, relative_ridge


#: Rows that a kernel's points and bandwidth are taken from; a larger calibration set is drawn from, and regressed on whole.
POOL_ROWS = 2000
#: Pilots that the driver takes as rows; and those of a map whose Gram stays distributed.
MAX_PILOTS, MOST_POINTS = 24_000, 500_000
#: Pilots whose Gram the driver solves, 32 MB; more keep it distributed.
MAX_GRAM = 2000
#: Bytes of the weights of all lambdas that meet the same kernel values.
WEIGHT_BYTES = 64 << 20


def fitted_kernel(kernel: Kernel, x: np.ndarray) -> Kernel:
    """The kernel with the median bandwidth of at most MEDIAN_ROWS rows, drawn by a seeded permutation, as rows come ordered by id."""
    if len(x) > MEDIAN_ROWS:
        x = x[np.random.default_rng(0).permutation(len(x))[:MEDIAN_ROWS]]
    return kernel.fitted(median_of(x))


class Centred:
    """A kernel to fixed points, centred by the means of those points; a row's value doesn't depend on its batch."""

    def __init__(self, kernel: Kernel, points: np.ndarray, center: bool = True) -> None:
        self.kernel, self.points, self.center = kernel, points, center
        gram = kernel.block(points, points)
        self.columns, self.grand = gram.mean(axis=0), gram.mean()
        self.gram = self(points)

    @classmethod
    def by_means(cls, kernel: Kernel, points: np.ndarray, columns: np.ndarray, grand: float, center: bool = True) -> Centred:
        """Of known means, without the points' own Gram."""
        out = cls.__new__(cls)
        out.kernel, out.points, out.center, out.columns, out.grand, out.gram = kernel, points, center, columns, grand, None
        return out

    def centre(self, k: np.ndarray) -> np.ndarray:
        """Kernel rows to the points, centred."""
        return k - k.mean(axis=1, keepdims=True) - self.columns + self.grand if self.center else k

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return self.centre(self.kernel.block(z, self.points))

    def times(self, z: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Rows of z times weights; their own means are one more weight, so that no row is made whole."""
        if not self.center:
            return kernel_product(self.kernel, z, self.points, weights)
        found = kernel_product(self.kernel, z, self.points, np.concatenate([np.full((len(self.points), 1), 1 / len(self.points)), weights], axis=1))
        sums = weights.sum(axis=0)
        return found[:, 1:] - found[:, :1] * sums - self.columns @ weights + self.grand * sums


class ResidualSolver:
    """min |E - K A|^2 + r <A, K A>, with X'KA = 0 if asked, for any r from one eigendecomposition."""

    def __init__(self, gram: np.ndarray, x: np.ndarray, residual: np.ndarray, orthogonal: bool = True, ridge: float = 1e-8) -> None:
        s, self.v = np.linalg.eigh((gram + gram.T) / 2)
        self.s = np.maximum(s, 0)
        self.x, self.e, self.orthogonal, self.ridge = self.v.T @ x, self.v.T @ residual, orthogonal, ridge

    def scale(self, units: str) -> float:
        """Of a relative lambda: rows ('n'), rows times the mean non-zero eigenvalue ('trace'), or 1 ('plain')."""
        live = self.s[self.s > 1e-10 * max(self.s.max(initial=0), 1e-300)]
        mean = live.mean() if len(live) else 1.0
        return {"n": len(self.s), "trace": len(self.s) * mean, "plain": 1.0}[units]

    def solve(self, r: float, moved: np.ndarray | None = None) -> np.ndarray:
        """moved: of the residual less x times it."""
        h = self.s / (self.s + r)
        m = e = self.e if moved is None else self.e - self.x @ moved
        if self.orthogonal:
            b = self.x.T @ (h[:, None] * self.x)
            m = m - self.x @ np.linalg.solve(relative_ridge(b, self.ridge), self.x.T @ (h[:, None] * e))
        return self.v @ (m / (self.s + r)[:, None])


class RKHSAligner(Aligner):
    """A rigid map plus a kernel residual that is orthogonal to the source, f(z) = Qz + A'k(z).

    Up to ``MAX_GRAM`` pilots (``max_points``, if fewer) are solved by their Gram on the driver. More, to ``MOST_POINTS``, keep it
    distributed: a Krylov basis serves every lambda asked for (those of the grid, or the one given), and wants them not too small;
    where they are, and for lambdas in units of the Gram's eigenvalues, up to ``max_points`` pilots take the Gram all the same.
    """

    needs_rows = True
    fits_tables = True
    spark = None

    def __init__(self, kernel: Kernel | None = None, lam: float | None = None, lam_grid: tuple[float, ...] = tuple(10.0**e for e in range(-8, 3)), val_fraction: float = 0.2, selection: str = "nmse", lam_scaling: str = "n", center_kernel: bool = True, orthogonal_residual: bool = True, rigid_stage: bool = True, ridge_b: float = 1e-8, seed: int = 0, max_points: int = MAX_PILOTS, **chart) -> None:
        super().__init__(max_points=max_points, **chart)
        if selection not in ("nmse", "cosine"):
            raise ValueError(f"unknown selection {selection!r}")
        self.kernel, self.lam, self.lam_grid, self.val_fraction, self.selection = kernel or Kernel(), lam, lam_grid, val_fraction, selection
        self.lam_scaling, self.center_kernel, self.orthogonal, self.rigid_stage, self.ridge_b, self.seed = lam_scaling, center_kernel, orthogonal_residual, rigid_stage, ridge_b, seed

    def fit(self, src: DataFrame, tgt: DataFrame, src_context: DataFrame | None = None, tgt_context: DataFrame | None = None) -> Aligner:
        self.spark = src.sparkSession
        return super().fit(src, tgt, src_context, tgt_context)

    def solver_of(self, x: np.ndarray, residual: np.ndarray, lam: float | None = None) -> tuple[Centred, ResidualSolver | KrylovSolver]:
        """The centred kernel to the points x and the solver of a residual on them; lam: what a basis is first made for, if not the map's or the least of its grid."""
        most = self.max_points if self.lam_scaling == "trace" else min(self.max_points, MAX_GRAM)
        if len(x) > most and self.spark is not None:
            least = (lam or self.lam or min(self.lam_grid)) * (len(x) if self.lam_scaling == "n" else 1.0)
            try:
                solver = KrylovSolver(DistributedGram(self.spark, self.fitted, x), x, residual, least, self.orthogonal, self.ridge_b, self.center_kernel)
                return Centred.by_means(self.fitted, x, solver.columns, solver.grand, self.center_kernel), solver
            except BasisTooWide:
                if len(x) > self.max_points:
                    raise
        centred = Centred(self.fitted, x, self.center_kernel)
        return centred, ResidualSolver(centred.gram, x, residual, self.orthogonal, self.ridge_b)

    def _parts(self, x: np.ndarray, y: np.ndarray, lam: float | None = None) -> tuple[np.ndarray, np.ndarray, Centred, ResidualSolver | KrylovSolver]:
        q = procrustes(x.T @ y, 1.0)[0] if self.rigid_stage else np.zeros((y.shape[1], x.shape[1]))
        offset = np.zeros(y.shape[1]) if self.rigid_stage else y.mean(axis=0)
        return q, offset, *self.solver_of(x, y - x @ q.T - offset, lam)

    def _fit_table(self, both: DataFrame) -> None:
        rows = both.select("sample_id", "x", "y").orderBy("sample_id").limit(MOST_POINTS + 1).toArrow()
        if rows.num_rows > MOST_POINTS:
            raise ValueError(f"more than {MOST_POINTS} pilots")
        self.n_pilots = rows.num_rows
        self._fit_rows(matrix(rows.column("x")), matrix(rows.column("y")), rows.column("sample_id").to_numpy())

    def __getstate__(self) -> dict:
        # Tasks apply the map; they have no session, and a basis as large as its points is not sent to them.
        return {k: v for k, v in self.__dict__.items() if k != "spark" and not (k == "solver" and isinstance(v, KrylovSolver))}

    def _residuals(self, z: np.ndarray, centred: Centred, weights: list[np.ndarray]) -> list[np.ndarray]:
        """Centred kernel rows of z times each of the weights; distributed where the fit is."""
        if centred.gram is not None:
            k = centred(z)
            return [k @ a for a in weights]
        joined = np.concatenate([np.full((len(centred.points), 1), 1 / len(centred.points)), *weights], axis=1)
        found = DistributedGram(self.spark, self.fitted, centred.points, z)(joined)
        if centred.center:
            sums = joined[:, 1:].sum(axis=0)
            found[:, 1:] += -found[:, :1] * sums - centred.columns @ joined[:, 1:] + centred.grand * sums
        return np.split(found[:, 1:], len(weights), axis=1)

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.fitted = fitted_kernel(self.kernel, x)
        lam = self.lam if self.lam is not None else self._selected(x, y)
        self.q, self.offset, self.centred, self.solver = self._parts(x, y, lam)
        self.x = x
        self.set_lam(lam)

    def residual_rows(self, z: np.ndarray, centred: Centred | None = None, a: np.ndarray | None = None) -> np.ndarray:
        """What the residual stage adds to rows of z on the source's chart; of another fit on the same kernel if one is given."""
        return self._residuals(z, self.centred if centred is None else centred, [self.a if a is None else a])[0]

    def _residuals_by_lam(self, z: np.ndarray, centred: Centred, solver: ResidualSolver | KrylovSolver) -> Iterator[np.ndarray]:
        """_residuals of each lambda of the grid, for as many at a time as their weights fit ``WEIGHT_BYTES``."""
        size = max(1, WEIGHT_BYTES // max(1, solver.e.nbytes))
        for at in range(0, len(self.lam_grid), size):
            yield from self._residuals(z, centred, [solver.solve(lam * solver.scale(self.lam_scaling)) for lam in self.lam_grid[at : at + size]])

    def _selected(self, x: np.ndarray, y: np.ndarray) -> float:
        order = np.random.default_rng(self.seed).permutation(len(x))
        n = max(1, round(self.val_fraction * len(x)))
        held, rest = order[:n], order[n:]
        q, offset, centred, solver = self._parts(x[rest], y[rest])
        base, scores = x[held] @ q.T + offset, []
        for moved in self._residuals_by_lam(x[held], centred, solver):
            p = base + moved
            if self.selection == "nmse":
                scores.append(np.sum((p - y[held]) ** 2) / max(np.sum(y[held] ** 2), 1e-300))
            else:
                scores.append(-np.mean(np.sum(p * y[held], 1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(y[held], axis=1), 1e-12)))
        return self.lam_grid[int(np.argmin(scores))]

    def set_lam(self, lam: float) -> RKHSAligner:
        """Another lambda on the same eigendecomposition."""
        self.lam_used = lam
        self.a = self.solver.solve(lam * self.solver.scale(self.lam_scaling))
        return self

    def _map(self, z: np.ndarray) -> np.ndarray:
        return z @ self.q.T + self.offset + self.centred.times(z, self.a)

    def apply_linear(self, x: np.ndarray) -> np.ndarray:
        """The rigid stage alone."""
        return self.tgt.invert(self.src.apply(x) @ self.q.T + self.offset)

    def transform_linear(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return map_vectors(df, self.apply_linear, vector, vector)

    def diagnostics(self) -> dict[str, float]:
        s, gram = self.solver.s, self.centred.gram
        if gram is None:  # of a distributed fit the basis' eigenvalues alone are known
            live = s[s > 1e-10 * s.max(initial=1e-300)]
            return {"capacity": None, "gram_cond": float(live.max() / live.min()), "gram_flatness": None, "orthogonality": None, "lam": self.lam_used}
        live = s[s > 1e-10 * s.max(initial=1e-300)]
        g = gram @ self.a
        return {
            "capacity": int(np.linalg.matrix_rank(gram, hermitian=True) - np.linalg.matrix_rank(self.x)), "gram_cond": float(live.max() / live.min()) if len(live) else 0.0,
            "gram_flatness": float(live.max() / live.mean()) if len(live) else 0.0, "orthogonality": float(np.abs(g.T @ self.x).max()), "lam": self.lam_used,
        }

    @property
    def map_parameters(self) -> int:
        return self.q.size + self.centred.points.size + self.a.size


def drawn(n: int, size: int, seed: int) -> np.ndarray:
    """Sorted places of a seeded draw of size of n rows; all if size covers them."""
    return np.arange(n) if size >= n else np.sort(np.random.default_rng(seed).choice(n, size, replace=False))


class _Reduced:
    """Centred kernel rows as few columns.

    'svd': on the directions that hold a share of the singular-value mass of the rows to all points; 'subset': rows to a
    draw of points, one column each; 'hybrid': the directions of rows to a draw of ``n_subset`` points. Columns that the
    calibration rows can't support, n - 1 of them, are not made.
    """

    def __init__(self, kernel: Kernel, pool: np.ndarray, rank: int | float, basis: str = "svd", n_subset: int | None = None, n_rows: int | None = None, seed: int = 0) -> None:
        most = max(1, (n_rows or len(pool)) - 1)
        size = len(pool)
        if basis == "subset":
            size = min(max(1, round(rank * len(pool)) if isinstance(rank, float) else rank), most)
        elif basis == "hybrid" and n_subset:
            size = n_subset
        points = pool[drawn(len(pool), size, seed)]
        self.centred = Centred(kernel, points)
        self.basis = np.eye(len(points))
        if basis != "subset":
            _, s, vt = np.linalg.svd(self.centred(pool), full_matrices=False)
            k = min(rank_for(s, rank), most, max(1, int(np.sum(s > 1e-10 * s[0]))))
            self.basis = vt[:k].T

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return self.centred(z) @ self.basis




class KCCAAligner(Aligner):
    """Canonical correlation of reduced kernel rows; the source's scores cross the channel and are read out by ridge.

    More than ``max_points`` pilots stay where they are and give sums of products; the driver receives those and the pool.
    """

    needs_rows = True
    fits_tables = True

    def __init__(self, kernel: Kernel | None = None, kernel_tgt: Kernel | None = None, n_basis_src: int | float = 0.99, n_basis_tgt: int | float = 0.99, n_canonical: int | None = None, reg: float = 1e-3, readout: str = "source", readout_reg: float = 1e-6, basis: str = "svd", n_subset: int | None = None, bandwidth: str = "median", pool_rows: int = POOL_ROWS, seed: int = 0, preprocess: str = "standard", max_points: int = MAX_PILOTS, **chart) -> None:
        super().__init__(preprocess=preprocess, max_points=max_points, **chart)
        if basis not in ("svd", "subset", "hybrid") or readout not in ("source", "target") or bandwidth not in ("median", "rule_of_thumb"):
            raise ValueError(f"unknown setting among {basis!r}, {readout!r}, {bandwidth!r}")
        self.kernel, self.kernel_tgt = kernel or Kernel(), kernel_tgt or kernel or Kernel()
        self.n_basis_src, self.n_basis_tgt, self.n_canonical, self.reg, self.readout_reg = n_basis_src, n_basis_tgt, n_canonical, reg, readout_reg
        self.readout_of, self.basis, self.n_subset, self.bandwidth, self.pool_rows, self.seed = readout, basis, n_subset, bandwidth, pool_rows, seed

    def _reduced(self, kernel: Kernel, pool: np.ndarray, rank: int | float, n: int) -> _Reduced:
        if self.bandwidth == "rule_of_thumb" and kernel.gamma is None and kernel.name in ("rbf", "laplacian"):
            kernel = replace(kernel, gamma=rule_of_thumb_gamma(pool, kernel.scale))
        return _Reduced(fitted_kernel(kernel, pool), pool, rank, self.basis, self.n_subset, n, self.seed)

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        n, pool = len(x), drawn(len(x), self.pool_rows, self.seed)
        self.reduced, target = self._reduced(self.kernel, x[pool], self.n_basis_src, n), self._reduced(self.kernel_tgt, y[pool], self.n_basis_tgt, n)
        f, g = self.reduced(x), target(y)
        self.mean, self.offset = f.mean(axis=0), y.mean(axis=0)
        f, g, y = f - self.mean, g - g.mean(axis=0), y - self.offset
        self._fit_products(n, f.T @ f, f.T @ g, g.T @ g, f.T @ y, g.T @ y)

    def _fit_table(self, both: DataFrame) -> None:
        both = cut_lineage(both.select("sample_id", "x", "y"))
        n = self.n_pilots = both.count()
        x, y = drawn_pairs(both, drawn(n, self.pool_rows, self.seed))
        self.reduced = source = self._reduced(self.kernel, x, self.n_basis_src, n)
        target = self._reduced(self.kernel_tgt, y, self.n_basis_tgt, n)

        def make(batch: pa.RecordBatch) -> np.ndarray:
            x, y = matrix(batch.column("x")), matrix(batch.column("y"))
            return np.concatenate([source(x), target(y), y], axis=1)

        moment = made_moment(both, make)
        means = moment[0, 1:] / n
        centred = moment[1:, 1:] - n * np.outer(means, means)
        k, m = source.basis.shape[1], source.basis.shape[1] + target.basis.shape[1]
        self.mean, self.offset = means[:k], means[m:]
        self._fit_products(n, centred[:k, :k], centred[:k, k:m], centred[k:m, k:m], centred[:k, m:], centred[k:m, m:])

    def _fit_products(self, n: int, ff: np.ndarray, fg: np.ndarray, gg: np.ndarray, fy: np.ndarray, gy: np.ndarray) -> None:
        """From products of centred source and target columns and targets over n rows."""
        self.a, b, self.all_correlations = canonical(ff / n, fg / n, gg / n, self.reg)
        self.bases = len(ff), len(gg)
        self.correlations = self.all_correlations[: self.n_canonical]
        self.a, b = self.a[:, : self.n_canonical], b[:, : self.n_canonical]
        own, cross = (b.T @ gg @ b, b.T @ gy) if self.readout_of == "target" else (self.a.T @ ff @ self.a, self.a.T @ fy)
        self.readout = np.linalg.solve(relative_ridge(own, self.readout_reg), cross)

    def _scores(self, z: np.ndarray) -> np.ndarray:
        return (self.reduced(z) - self.mean) @ self.a

    def _map(self, z: np.ndarray) -> np.ndarray:
        return self._scores(z) @ self.readout + self.offset

    def transmit(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return map_vectors(df, lambda x: self._scores(self.src.apply(x)), vector, vector)

    def receive(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return map_vectors(df, lambda s: self.tgt.invert(s @ self.readout + self.offset), vector, vector)

    def log_association(self) -> float:
        """-sum log(1 - r^2) over all canonical correlations of the two bases, sent or not."""
        r = np.minimum(self.all_correlations, 1 - 1e-12)
        return float(-np.log1p(-(r**2)).sum())

    def independence_p(self, spark) -> float:
        """Bartlett's chi-squared test of no association of the two bases; NaN where they have as many columns as there are pilots."""
        m1, m2 = self.bases
        if self.n_pilots <= m1 + m2:
            return float("nan")
        statistic = (self.n_pilots - (m1 + m2 + 1) / 2) * self.log_association()
        chi = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(m1 * m2))
        return float(1 - chi.cumulativeProbability(float(statistic)))

    @property
    def transmitted_symbols(self) -> int:
        return self.a.shape[1]

    @property
    def map_parameters(self) -> int:
        return self.reduced.centred.points.size + self.reduced.basis.size + self.a.size + self.readout.size


def local_cka(kx: np.ndarray, kx_self: np.ndarray, ly: np.ndarray, ly_self: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """CKA of a base set with one more pair, for every (query, candidate): rows kx to the base, k and m its Grams.

    Centred products of the enlarged Grams come from sums of the base and of the added row and column.
    """
    n = len(k) + 1

    def inner(a, a_self, b, b_self, p, q, pairs):
        mix = a @ b.T if pairs else np.sum(a * b, axis=1)
        row_a, row_b = a.sum(1) + a_self, b.sum(1) + b_self
        own, total_a, total_b = np.sum(p * q), p.sum() + 2 * a.sum(1) + a_self, q.sum() + 2 * b.sum(1) + b_self
        ra, rb, r = p.sum(1), q.sum(1), p.sum(1) @ q.sum(1)
        if pairs:
            products = own + 2 * mix + np.outer(a_self, b_self)
            rows = r + (b @ ra)[None] + (a @ rb)[:, None] + mix + np.outer(row_a, row_b)
            return products - 2 * rows / n + np.outer(total_a, total_b) / n**2
        products = own + 2 * mix + a_self * b_self
        rows = r + b @ ra + a @ rb + mix + row_a * row_b
        return products - 2 * rows / n + total_a * total_b / n**2

    cross = inner(kx, kx_self, ly, ly_self, k, m, True)
    spread = np.outer(inner(kx, kx_self, kx, kx_self, k, k, False), inner(ly, ly_self, ly, ly_self, m, m, False))
    return np.where(spread > 0, cross / np.sqrt(np.maximum(spread, 1e-300)), 0.0)


class CKAAligner(Aligner):
    """Centred kernel rows to a base set of pilots, read out by ridge, or matched to target pilots by local CKA.

    strategy: the base set, medoids of k-means ('kmeans') or a draw ('random'). readout: the side whose rows the ridge is
    fitted on; 'target' fits the receiver's own rows, so that only the base set is spent.
    More than ``max_points`` pilots stay where they are: the base set comes by distributed k-means and the ridge from sums of products.
    """

    needs_rows = True
    fits_tables = True

    def __init__(self, n_anchors: int | None = 320, kernel: Kernel | None = None, kernel_tgt: Kernel | None = None, strategy: str = "kmeans", decode: str = "ridge", readout: str = "source", decode_alpha: float = 1e-2, match_temperature: float = 0.25, pool_rows: int = POOL_ROWS, seed: int = 0, preprocess: str = "standard", max_points: int = MAX_PILOTS, **chart) -> None:
        super().__init__(preprocess=preprocess, max_points=max_points, **chart)
        if decode not in ("ridge", "match") or readout not in ("source", "target") or strategy not in ("kmeans", "random"):
            raise ValueError(f"unknown setting among {decode!r}, {readout!r}, {strategy!r}")
        self.n_anchors, self.kernel, self.kernel_tgt, self.strategy = n_anchors, kernel or Kernel(), kernel_tgt or kernel or Kernel(), strategy
        self.decode, self.readout_of, self.decode_alpha, self.temperature, self.pool_rows, self.seed = decode, readout, decode_alpha, match_temperature, pool_rows, seed

    def _base(self, x: np.ndarray) -> np.ndarray:
        k = min(len(x), self.n_anchors or min(self.src.out_dim, self.tgt.out_dim))
        if self.strategy == "random":
            return drawn(len(x), k, self.seed)
        label = lloyd(x, k, self.seed)
        groups = [np.flatnonzero(label == j) for j in np.unique(label)]
        return np.unique([g[sq_dists(x[g], x[g].mean(axis=0, keepdims=True))[:, 0].argmin()] for g in groups])

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        base, pool = self._base(x), drawn(len(x), self.pool_rows, self.seed)
        self.kx, self.ky = fitted_kernel(self.kernel, x[pool]), fitted_kernel(self.kernel_tgt, y[pool])
        self.centred, self.x, self.y = Centred(self.kx, x[base]), x[base], y[base]
        self.pool = y[pool]
        phi = Centred(self.ky, self.y)(y) if self.readout_of == "target" else self.centred(x)
        self.offset = y.mean(axis=0)
        self.readout = np.linalg.solve(relative_ridge(phi.T @ phi, self.decode_alpha), phi.T @ (y - self.offset))

    def _fit_table(self, both: DataFrame) -> None:
        both = cut_lineage(both.select("sample_id", "x", "y"))
        n = self.n_pilots = both.count()
        k = min(n, self.n_anchors or min(self.src.out_dim, self.tgt.out_dim))
        if self.strategy == "random":
            self.x, self.y = drawn_pairs(both, drawn(n, k, self.seed))
        else:
            self.x, self.y = pairs_of(medoid_pairs(table_clusters(both, k, self.seed)), "sample_id")
        pool, self.pool = drawn_pairs(both, drawn(n, self.pool_rows, self.seed))
        self.kx, self.ky = fitted_kernel(self.kernel, pool), fitted_kernel(self.kernel_tgt, self.pool)
        self.centred = Centred(self.kx, self.x)
        rows, side = (Centred(self.ky, self.y), "y") if self.readout_of == "target" else (self.centred, "x")
        moment = made_moment(both, lambda batch: np.concatenate([rows(matrix(batch.column(side))), matrix(batch.column("y"))], axis=1))
        m = 1 + len(self.x)
        self.offset = moment[0, m:] / n
        self.readout = np.linalg.solve(relative_ridge(moment[1:m, 1:m], self.decode_alpha), moment[1:m, m:] - np.outer(moment[0, 1:m], self.offset))

    def _matched(self, rows: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Local CKA with candidates of source rows given by kernel values to the base set and to themselves."""
        other = np.array([self.ky.block(r[None], r[None])[0, 0] for r in candidates])
        return local_cka(rows, own, self.ky.block(candidates, self.y), other, self.kx.block(self.x, self.x), self.ky.block(self.y, self.y))

    def scores(self, z: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Local CKA of standardised source rows with standardised target candidates."""
        return self._matched(self.kx.block(z, self.x), np.array([self.kx.block(r[None], r[None])[0, 0] for r in z]), candidates)

    def _decoded(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        if self.decode == "ridge":
            return self.centred.centre(rows) @ self.readout + self.offset
        s = self._matched(rows, own, self.pool)
        if self.temperature <= 0:  # the best candidate alone
            return self.pool[s.argmax(axis=1)]
        s = (s - s.mean(axis=1, keepdims=True)) / np.maximum(s.std(axis=1, keepdims=True), 1e-12)
        w = np.exp((s - s.max(axis=1, keepdims=True)) / self.temperature)
        return (w / w.sum(axis=1, keepdims=True)) @ self.pool

    def _map(self, z: np.ndarray) -> np.ndarray:
        own = np.array([self.kx.block(r[None], r[None])[0, 0] for r in z]) if self.decode == "match" else np.ones(len(z))
        return self._decoded(self.kx.block(z, self.x), own)

    def transmit(self, df: DataFrame, vector: str = "v") -> DataFrame:
        """Raw kernel values of each row to the base set; the receiver centres them."""
        return map_vectors(df, lambda x: self.kx.block(self.src.apply(x), self.x), vector, vector)

    def self_similarity(self, df: DataFrame, name: str = "self_similarity", vector: str = "v") -> DataFrame:
        """df with each row's kernel value to itself, which a match of an unnormalised kernel needs beside what is transmitted."""
        own = lambda x: np.array([self.kx.block(r[None], r[None])[0] for r in self.src.apply(x)])
        return map_vectors(df.withColumn("_row", F.col(vector)), own, "_row", "_own").withColumn(name, F.col("_own")[0]).drop("_own")

    def receive(self, df: DataFrame, vector: str = "v", self_similarity: str | None = None) -> DataFrame:
        """Target rows of transmitted values.

        A match needs k(z, z): 1 for kernels that normalise themselves, else the column ``self_similarity``.
        """
        if self.decode != "match":
            return map_vectors(df, lambda rows: self.tgt.invert(self._decoded(rows, np.ones(len(rows)))), vector, vector)
        if self_similarity is None and self.kx.name in ("linear", "polynomial"):
            raise ValueError(f"a match of {self.kx.name} kernel values needs each row's own value")
        own = F.col(self_similarity) if self_similarity else F.lit(1.0)
        sent = df.withColumn("_sent", F.concat(vector, F.array(own.cast("double"))))
        return map_vectors(sent, lambda rows: self.tgt.invert(self._decoded(rows[:, :-1], rows[:, -1])), "_sent", vector).drop("_sent")

    def match_rows(self, src: DataFrame, tgt: DataFrame) -> DataFrame:
        """``(sample_id, matched, score, price, profit)``: rows of two tables of equal size matched by local CKA, by an auction over blocks."""
        return assign(self.src.transform(src.select("sample_id", "v")), self.tgt.transform(tgt.select("sample_id", "v")), self.scores)

    def match(self, z: np.ndarray, y: np.ndarray, method: str = "lsa") -> np.ndarray:
        """Target row of each source row (raw, equally many): by assignment on local CKA, or by aligning whole Grams."""
        if len(z) != len(y):
            raise ValueError("sides differ in size")
        z, y = self.src.apply(z), self.tgt.apply(y)
        if method == "lsa":
            return assignment(-self.scores(z, y))
        a, b = np.concatenate([self.x, z]), np.concatenate([self.y, y])
        order = quadratic_assignment(Centred(self.kx, a).gram, Centred(self.ky, b).gram, fixed=len(self.x))
        return order[len(self.x) :] - len(self.x)

    @property
    def paired_samples_used(self) -> int:
        return self.n_pilots if self.decode == "ridge" and self.readout_of == "source" else len(self.x)

    @property
    def transmitted_symbols(self) -> int:
        return len(self.x)

    @property
    def map_parameters(self) -> int:
        return self.x.size + self.readout.size
