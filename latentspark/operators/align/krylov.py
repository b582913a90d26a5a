"""Regularised kernel solves without a Gram matrix: a block Krylov basis from distributed products, one for all ridges.

The Gram of n points is met only as a product with a block of vectors: a task makes the cells of its points with all
others a tile at a time, multiplies and forgets them, and returns its points' rows. The basis is grown from
[source rows, residuals] by such products, each block orthogonal to all before it; in it the Gram is a block
tridiagonal matrix, in which the systems of every ridge are solved block by block. It grows until the systems of
the smallest ridge asked for are solved to ``TOLERANCE``, which a residual shows that costs nothing more, and
further where a smaller ridge is asked for later.

The driver holds the basis (n x its width), never n x n numbers: up to ``HELD_BYTES`` in memory and beyond that in files, of
which one block is read at a time, to ``MAX_BASIS_BYTES``; beyond that is an error.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from latentspark.functions.kernels import Kernel
from latentspark.operators.linalg import relative_ridge

HELD_BYTES, MAX_BASIS_BYTES = 256 << 20, 32 << 30
#: Relative residual of the smallest ridge at which a basis is wide enough, and products at most.
TOLERANCE, MOST_STEPS = 1e-9, 200
#: Directions whose length falls below this share are no directions.
DEFLATED = 1e-12
#: Sides of the tiles of cells that are made at a time, and rows of a task at most.
TILE, TASK_ROWS = (128, 1024), 4096


class BasisTooWide(ValueError):
    """A kernel solve wants a wider basis than the driver may hold or than its products reach."""


def kernel_product(kernel: Kernel, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel values of left with right times weights, by tiles that stay in a core's cache."""
    out, cells = np.zeros((len(left), weights.shape[1])), np.empty(TILE[0] * TILE[1])
    for j in range(0, len(right), TILE[1]):
        some, by = right[j : j + TILE[1]], weights[j : j + TILE[1]]
        for i in range(0, len(left), TILE[0]):
            rows = left[i : i + TILE[0]]
            out[i : i + TILE[0]] += kernel.block(rows, some, cells[: len(rows) * len(some)].reshape(len(rows), -1)) @ by
    return out


class DistributedGram:
    """Products of kernel values of left points with right points and a matrix of the driver's."""

    def __init__(self, spark: SparkSession, kernel: Kernel, right: np.ndarray, left: np.ndarray | None = None, block: int | None = None) -> None:
        self.context, self.kernel, self.n = spark.sparkContext, kernel, len(right if left is None else left)
        # Points are those of a fit, a budget; sent once for all products.
        self.points = self.context.broadcast((right, right if left is None else left))
        rows = block or min(TASK_ROWS, max(1, -(-self.n // (2 * self.context.defaultParallelism))))
        self.tasks = [(k, min(k + rows, self.n)) for k in range(0, self.n, rows)]

    def __call__(self, q: np.ndarray) -> np.ndarray:
        kernel, points = self.kernel, self.points
        # As many numbers as one product returns; a block of the basis.
        shared = self.context.broadcast(q)

        def work(task: tuple[int, int]) -> tuple[int, bytes]:
            right, left = points.value
            some = left[task[0] : task[1]]
            return task[0], kernel_product(kernel, some, right, shared.value).tobytes()

        out = np.zeros((self.n, q.shape[1]))
        if self.tasks:
            for at, found in self.context.parallelize(self.tasks, len(self.tasks)).map(work).collect():
                part = np.frombuffer(found).reshape(-1, q.shape[1])
                out[at : at + len(part)] = part
        shared.unpersist()
        return out


class _Blocks:
    """A basis' blocks of columns, in memory up to HELD_BYTES and the others in files."""

    def __init__(self) -> None:
        self.kept: list[np.ndarray | str] = []
        self.bytes, self.folder = 0, None

    def append(self, block: np.ndarray) -> None:
        self.bytes += block.nbytes
        if self.bytes > HELD_BYTES:
            self.folder = self.folder or tempfile.TemporaryDirectory(prefix="basis-")
            path = f"{self.folder.name}/{len(self.kept)}.npy"
            np.save(path, block)
            self.kept.append(path)
        else:
            self.kept.append(block)

    def __len__(self) -> int:
        return len(self.kept)

    def __getitem__(self, k: int) -> np.ndarray:
        return np.load(self.kept[k]) if isinstance(self.kept[k], str) else self.kept[k]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self)))


class KrylovSolver:
    """min |E - K A|^2 + r <A, K A>, with X'KA = 0 if asked, as ``ResidualSolver`` solves it, for any r."""

    def __init__(self, gram: DistributedGram, x: np.ndarray, residual: np.ndarray, least: float, orthogonal: bool = True, ridge: float = 1e-8, center: bool = True, tolerance: float = TOLERANCE) -> None:
        self.gram, self.center, self.tolerance = gram, center, tolerance
        self.x, self.e, self.orthogonal, self.ridge, self.n = x, residual, orthogonal, ridge, len(x)
        self.columns = gram(np.ones((self.n, 1)))[:, 0] / self.n
        self.grand = float(self.columns.mean())
        self.start = np.concatenate([x, residual], axis=1)
        self.size = max(float(np.linalg.norm(self.start)), 1e-300)
        self.blocks = _Blocks()
        #: Blocks of the Gram in the basis: on its diagonal, and from each to the one below.
        self.diagonal: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        self._next, self.least, self.products = self._directions(self.start, self.size), np.inf, 0
        self.first = self._next.T @ self.start
        self._grow(least)

    def _centred(self, q: np.ndarray) -> np.ndarray:
        if not self.center:
            return self.gram(q)
        out = self.gram(q - q.mean(axis=0))
        return out - out.mean(axis=0)

    def _grow(self, least: float) -> None:
        """Widens the basis until the ridge ``least`` is solved; what is held already serves."""
        if len(self.blocks) and self._next.shape[1] and self._short(least) <= self.tolerance * self.size:
            self.least = least
            return
        while self._next.shape[1]:
            new = self._next
            if len(self.blocks) >= MOST_STEPS:
                raise BasisTooWide(f"a kernel solve is unfinished after {MOST_STEPS} products")
            if self.blocks.bytes + new.nbytes > MAX_BASIS_BYTES:
                raise BasisTooWide("the basis of a kernel solve is too large for the driver: a larger ridge needs a smaller one")
            self.blocks.append(new)
            image = self._centred(new)
            self.products += new.shape[1]
            own = new.T @ image
            self.diagonal.append((own + own.T) / 2)
            self._next = self._directions(image, float(np.linalg.norm(image)))
            self.below.append(self._next.T @ image)
            if self._short(least) <= self.tolerance * self.size:
                break
        self.least = least

    def _directions(self, block: np.ndarray, scale: float) -> np.ndarray:
        """Orthonormal directions of a block outside the basis."""
        for _ in range(2):
            block = self._outside(block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        u = u[:, s > DEFLATED * max(scale, 1e-300)]
        u = self._outside(u)
        return np.linalg.qr(u)[0] if u.shape[1] else u

    def _outside(self, block: np.ndarray) -> np.ndarray:
        block = block.copy()
        for b in self.blocks:
            block -= b @ (b.T @ block)
        return block

    def _forward(self, r: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Pivots and right sides of the elimination of (Gram + r) c = start in the basis."""
        pivots, sides = [], []
        for k, own in enumerate(self.diagonal):
            pivot, side = own + r * np.eye(len(own)), self.first if k == 0 else np.zeros((len(own), self.start.shape[1]))
            if k:
                low = self.below[k - 1]
                both = np.linalg.solve(pivots[-1], np.concatenate([low.T, sides[-1]], axis=1))
                pivot, side = pivot - low @ both[:, : low.shape[0]], side - low @ both[:, low.shape[0] :]
            pivots.append(pivot)
            sides.append(side)
        return pivots, sides

    def _short(self, r: float) -> float:
        """(K + r) V c - S of the solution: what the last block's image holds outside the basis."""
        pivots, sides = self._forward(r)
        return float(np.linalg.norm(self.below[-1] @ np.linalg.solve(pivots[-1], sides[-1])))

    def _solution(self, r: float) -> np.ndarray:
        pivots, sides = self._forward(r)
        out, c = np.zeros_like(self.start), None
        for k in range(len(pivots) - 1, -1, -1):
            c = np.linalg.solve(pivots[k], sides[k] if c is None else sides[k] - self.below[k].T @ c)
            out += self.blocks[k] @ c
        return out

    @property
    def basis(self) -> np.ndarray:
        return np.concatenate(self.blocks, axis=1)

    @property
    def s(self) -> np.ndarray:
        """Eigenvalues of the Gram in the basis, ascending."""
        ends = np.cumsum([0, *(len(d) for d in self.diagonal)])
        t = np.zeros((ends[-1], ends[-1]))
        for k, own in enumerate(self.diagonal):
            t[ends[k] : ends[k + 1], ends[k] : ends[k + 1]] = own
            if k + 1 < len(self.diagonal):
                t[ends[k + 1] : ends[k + 2], ends[k] : ends[k + 1]] = self.below[k]
        return np.maximum(np.linalg.eigvalsh(t), 0)

    def scale(self, units: str) -> float:
        """Of a relative lambda: rows ('n') or 1 ('plain'); the mean eigenvalue isn't known without a Gram."""
        return {"n": float(self.n), "plain": 1.0}[units]

    def solve(self, r: float, moved: np.ndarray | None = None) -> np.ndarray:
        """moved: of the residual less x times it, which the basis holds as well."""
        if r < self.least:
            self._grow(r)
        z = self._solution(r)
        zx, ze, e = z[:, : self.x.shape[1]], z[:, self.x.shape[1] :], self.e
        if moved is not None:
            ze, e = ze - zx @ moved, e - self.x @ moved
        if not self.orthogonal:
            return ze
        b, c = self.x.T @ (self.x - r * zx), self.x.T @ (e - r * ze)
        return ze - zx @ np.linalg.solve(relative_ridge(b, self.ridge), c)
