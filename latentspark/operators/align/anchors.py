"""Maps through similarities to anchors that both spaces share.

Up to ``max_points`` pilots are clustered on the driver. More stay where they are: clusters by MLlib's k-means with parallel
starts, means and medoids by grouped sums, readouts from moments; the driver receives anchors alone, which are a budget.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.functions.kernels import sq_dists
from latentspark.operators import selection
from latentspark.operators.align.base import Aligner
from latentspark.operators.blocks import cut_lineage, map_vectors, moment_matrix
from latentspark.operators.linalg import relative_ridge, svd
from latentspark.operators.spaces import mean_vectors


def parseval_frame(rows: np.ndarray) -> np.ndarray:
    """The nearest frame with orthonormal columns or rows, U V'."""
    u, _, vt = svd(rows)
    return u @ vt


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """Cluster of each row, by k-means from spread starts; for capped pilot sets."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        d = sq_dists(x, centres).min(axis=1)
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]]])
    for _ in range(rounds):
        label = sq_dists(x, centres).argmin(axis=1)
        moved = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    return sq_dists(x, centres).argmin(axis=1)


def table_clusters(both: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows of a table with ``cluster``, by distributed k-means of their x."""
    rows = both.withColumn("__features", array_to_vector("x"))
    return cut_lineage(KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", maxIter=50).fit(rows).transform(rows).drop("__features"))


def pairs_of(rows: DataFrame, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a few rows in an order."""
    found = rows.orderBy(*by).select("x", "y").collect()  # a budget of anchors
    return np.array([r.x for r in found]), np.array([r.y for r in found])


def drawn_pairs(both: DataFrame, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the rows at places of the id order."""
    return pairs_of(selection.at_positions(both, places.tolist()), "pos")


def medoid_pairs(said: DataFrame) -> DataFrame:
    """Rows of a clustered table that are the nearest to their cluster's mean of x."""
    chosen = selection.medoids(said.select("sample_id", F.col("x").alias("v"), "cluster"), "cluster").select("sample_id")
    return said.join(F.broadcast(chosen), "sample_id", "left_semi")  # a row a cluster


def pruned(rows: np.ndarray, threshold: float, seed: int = 0) -> np.ndarray:
    """Places of rows kept by farthest points in 1 - |cosine|, until the farthest is below the threshold."""
    u = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    kept = [int(np.random.default_rng(seed).integers(len(u)))]
    far = 1 - np.abs(u @ u[kept[0]])
    while len(kept) < len(u):
        nxt = int(far.argmax())
        if far[nxt] < threshold:
            break
        kept.append(nxt)
        far = np.minimum(far, 1 - np.abs(u @ u[nxt]))
    return np.array(kept)


TRANSFERS = ("indices", "clusters", "prototypes")


class RelativeAligner(Aligner):
    """Encode by similarity to anchors of the source, decode through the anchors of the target.

    anchor_transfer: the pilots nearest the source's cluster means ('indices'), the target's means over the
    source's clusters ('clusters'), or both sides' means over the same ``n_prototype_samples`` members of
    each cluster ('prototypes'; None: all members). n_anchors None: the narrower width.
    """

    needs_rows = True
    fits_tables = True

    def __init__(self, n_anchors: int | None = None, strategy: str = "kmeans", anchor_transfer: str = "indices", similarity: str = "cosine", parseval: bool = False, prune_threshold: float | None = None, n_subspaces: int = 1, decode: str = "pinv", decode_alpha: float = 1e-2, n_prototype_samples: int | None = None, seed: int = 0, preprocess: str = "center", **chart) -> None:
        super().__init__(preprocess=preprocess, **chart)
        if anchor_transfer not in TRANSFERS or decode not in ("pinv", "ridge") or similarity not in ("cosine", "inner"):
            raise ValueError(f"unknown setting among {anchor_transfer!r}, {decode!r}, {similarity!r}")
        if strategy == "random" and anchor_transfer != "indices":
            raise ValueError("random anchors have no clusters to transfer")
        self.n_anchors, self.strategy, self.anchor_transfer, self.similarity, self.parseval = n_anchors, strategy, anchor_transfer, similarity, parseval
        self.prune_threshold, self.n_subspaces, self.decode, self.decode_alpha, self.seed = prune_threshold, n_subspaces, decode, decode_alpha, seed
        self.n_prototype_samples = n_prototype_samples

    def _default_anchors(self, d_x: int, d_y: int) -> int:
        return min(d_x, d_y)

    def _anchors(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of both sides; ``support`` holds, for each, the places of the pilots it is made of."""
        k = min(len(x), self.n_anchors or self._default_anchors(x.shape[1], y.shape[1]))
        if self.strategy == "random":
            picks = np.sort(np.random.default_rng(self.seed).choice(len(x), k, replace=False))
            self.support = [picks[[j]] for j in range(k)]
            return x[picks], y[picks]
        label = lloyd(x, k, self.seed)
        groups = [np.flatnonzero(label == j) for j in range(label.max() + 1) if (label == j).any()]
        if self.anchor_transfer == "indices":
            medoids = np.array([g[sq_dists(x[g], x[g].mean(axis=0, keepdims=True))[:, 0].argmin()] for g in groups])
            self.support = [medoids[[j]] for j in range(len(medoids))]
            return x[medoids], y[medoids]
        if self.anchor_transfer == "prototypes" and self.n_prototype_samples:
            rng = np.random.default_rng(self.seed)
            groups = [np.sort(rng.choice(g, min(len(g), self.n_prototype_samples), replace=False)) for g in groups]
        self.support = groups
        return np.array([x[g].mean(axis=0) for g in groups]), np.array([y[g].mean(axis=0) for g in groups])

    def _encode(self, z: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        if self.similarity == "cosine":
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            anchors = anchors / np.maximum(np.linalg.norm(anchors, axis=1, keepdims=True), 1e-12)
        return z @ anchors.T

    def _table_anchors(self, both: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        """Anchors of both sides and the pilots that they are made of, by sums where the rows are."""
        k = min(self.n_pilots, self.n_anchors or self._default_anchors(self.src.out_dim, self.tgt.out_dim))
        if self.strategy == "random":
            return *drawn_pairs(both, np.sort(np.random.default_rng(self.seed).choice(self.n_pilots, k, replace=False))), k
        said = table_clusters(both, k, self.seed)
        if self.anchor_transfer == "indices":
            ax, ay = pairs_of(medoid_pairs(said), "cluster")
            return ax, ay, len(ax)
        if self.anchor_transfer == "prototypes" and self.n_prototype_samples:
            said = cut_lineage(selection.ranked(said, "cluster", self.seed, F.lit(self.n_prototype_samples)))
        means = mean_vectors(said, ["cluster"], "x", "x").join(mean_vectors(said, ["cluster"], "y", "y"), "cluster")
        return *pairs_of(means, "cluster"), said.count()

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        ax, ay = self._anchors(x, y)
        self.spent, self.n_made = len(np.unique(np.concatenate(self.support))), len(self.support)

        def products(sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            code = self._encode(y, sy)
            return code.T @ code, code.T @ y

        self._fit_parts(ax, ay, products, lambda: float(np.linalg.norm(y, axis=1).mean()))

    def _fit_table(self, both: DataFrame) -> None:
        both = cut_lineage(both.select("sample_id", "x", "y"))
        self.n_pilots = both.count()
        ax, ay, self.spent = self._table_anchors(both)
        self.n_made = len(ax)

        def products(sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            coded = map_vectors(both.select("y", F.col("y").alias("code")), lambda y: self._encode(y, sy), "code", "code")
            moment, k = moment_matrix(coded, "code", "y"), 1 + len(sy)
            return moment[1:k, 1:k], moment[1:k, k:]

        self._fit_parts(ax, ay, products, lambda: both.select(F.avg(vec.norm(F.col("y")))).first()[0])

    def _fit_parts(self, ax: np.ndarray, ay: np.ndarray, products: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], length: Callable[[], float]) -> None:
        """products: of codes to target anchors with themselves and with targets, over all pilots; length: the targets' mean."""
        if self.prune_threshold is None:
            subspaces = [np.arange(len(ax))]
        else:
            subspaces = [pruned(ax, self.prune_threshold, self.seed + j) for j in range(self.n_subspaces)]
        self.parts = []
        for keep in subspaces:
            sx, sy = ax[keep], ay[keep]
            if self.parseval:
                sx, sy = parseval_frame(sx), parseval_frame(sy)
            if self.decode == "ridge":
                own, cross = products(sy)
                back = np.linalg.solve(relative_ridge(own, self.decode_alpha), cross)
            else:
                back = np.linalg.pinv(sy if self.similarity == "inner" else sy / np.maximum(np.linalg.norm(sy, axis=1, keepdims=True), 1e-12)).T
            self.parts.append((sx, back))
        # Cosine codes have lost the length, which is given back as the pilots' mean.
        self.length = length() if self.similarity == "cosine" and self.decode != "ridge" else 1.0

    def _map(self, z: np.ndarray) -> np.ndarray:
        return self.length * np.mean([self._encode(z, sx) @ back for sx, back in self.parts], axis=0)

    @property
    def paired_samples_used(self) -> int:
        """Pilots that the anchors are made of; a ridge readout spends all."""
        return self.n_pilots if self.decode == "ridge" else self.spent

    @property
    def transmitted_symbols(self) -> int:
        return self.n_made

    @property
    def map_parameters(self) -> int:
        return sum(sx.size + back.size for sx, back in self.parts)


class PPFEAligner(RelativeAligner):
    """Prototype anchors made Parseval frames, with inner products; n_anchors None: the wider width."""

    def __init__(self, n_anchors: int | None = None, **rest) -> None:
        super().__init__(**{"n_anchors": n_anchors, "anchor_transfer": "prototypes", "similarity": "inner", "parseval": True} | rest)

    def _default_anchors(self, d_x: int, d_y: int) -> int:
        return max(d_x, d_y)
