"""Spectral descriptors of neighbour graphs and maps between their bases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators.blocks import cut_lineage, matrix
from latentspark.operators.linalg import fixed_signs

#: Nodes up to which the eigenproblem is solved as one dense matrix on the driver.
MAX_DENSE = 3000
#: Bytes of the eigenvectors that the driver returns; beyond them it is an error.
MAX_BASIS_BYTES = 2 << 30
#: Vectors held for each one wanted, at least; degree of the filter, its rounds at most, and the residual that ends them.
SPARE, DEGREE, ROUNDS, TOLERANCE = 8, 24, 60, 1e-7
#: Rows of a part at least, and those that a task multiplies at a time.
PART_ROWS, PRODUCT_ROWS = 1000, 4096
#: Bytes of a matrix (12 a cell) that a task may hold whole, cells that it multiplies at a time, the greatest degree there, and how far a filter may drive vectors apart.
WHOLE_BYTES, PRODUCT_CELLS, MOST_DEGREE, APART = 256 << 20, 1 << 20, 192, 1e10


class _Cells:
    """A symmetric matrix in parts of its rows, and vectors that lie beside them: a product sends each part the rows it needs of the others."""

    def __init__(self, cells: DataFrame, nodes: np.ndarray) -> None:
        self.context, self.n = cells.sparkSession.sparkContext, len(nodes)
        self.count = count = max(1, min(self.context.defaultParallelism, -(-len(nodes) // PART_ROWS)))
        self.bounds = bounds = np.linspace(0, len(nodes), count + 1).astype(np.int64)
        shared = self.context.broadcast(nodes)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                src, dst = (np.searchsorted(shared.value, batch.column(c).to_numpy()) for c in ("src", "dst"))
                part, l = np.searchsorted(bounds, src, "right") - 1, batch.column("l").to_numpy()
                for p in np.unique(part):
                    some = part == p
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "src": [(src[some] - bounds[p]).tobytes()], "dst": [dst[some].tobytes()], "l": [l[some].tobytes()]})

        def rows_of(found: Iterable) -> tuple[np.ndarray, ...]:
            """First cell of each row, cells by row, their columns among those needed, and these."""
            src, dst, l = (np.concatenate([np.frombuffer(f[k], kind) for f in found]) for found in [list(found)] for k, kind in enumerate((np.int64, np.int64, np.float64)))
            order = np.lexsort((dst, src))
            src, dst, l = src[order], dst[order], l[order]
            needed, column = np.unique(dst, return_inverse=True)
            return np.flatnonzero(np.diff(src, prepend=-1)), l, column, needed

        packed = cells.select("src", "dst", F.col("l").cast("double")).mapInArrow(pack, "part int, src binary, dst binary, l binary")
        rows = packed.rdd.map(lambda r: (r.part, (r.src, r.dst, r.l))).groupByKey(count).mapValues(rows_of).persist(StorageLevel.MEMORY_AND_DISK)
        self._keep(rows)

    def _keep(self, rows: RDD) -> None:
        """Rows of each part, with what the other parts need of its vectors."""
        bounds, count = self.bounds, self.count

        def asked(own: tuple[int, tuple]) -> Iterator[tuple]:
            p, (*_, needed) = own
            cuts = np.searchsorted(needed, bounds)
            for q in range(count):
                if cuts[q] < cuts[q + 1]:
                    yield q, (p, needed[cuts[q] : cuts[q + 1]] - bounds[q])

        sends = rows.flatMap(asked).groupByKey(count).mapValues(list)
        self.parts = rows.cogroup(sends, count).mapValues(lambda x: (next(iter(x[0]))[:3], next(iter(x[1])))).persist(StorageLevel.MEMORY_AND_DISK)
        self.top = self.parts.map(lambda x: float(np.add.reduceat(np.abs(x[1][0][1]), x[1][0][0]).max())).max()
        rows.unpersist()

    def degree(self, low: float, cut: float) -> int:
        return DEGREE

    def close(self) -> None:
        self.parts.unpersist()

    def start(self, m: int) -> RDD:
        return self.parts.map(lambda x: (x[0], (np.random.default_rng([0, x[0]]).normal(size=(len(x[1][0][0]), m)),)), preservesPartitioning=True)

    def filtered_products(self, x: RDD, middle: float, half: float, degree: int) -> RDD:
        """(part, (y, L y)) of vectors (part, (x,)), y being x with its parts outside of middle +- half enlarged by a Chebyshev polynomial of that degree."""

        def outgoing(own: tuple, state: tuple, sends: list) -> Iterator[tuple]:
            p = own
            yield p, (-1, state)
            for to, rows in sends:
                yield to, (p, state[-1][rows])

        def begin(item: tuple) -> Iterator[tuple]:
            p, (states, parts) = item
            return outgoing(p, next(iter(states)), next(iter(parts))[1])

        def product(met: Iterable, cells: tuple) -> tuple[tuple, np.ndarray]:
            met, (first, l, column) = dict(met), cells
            state, x = met.pop(-1), np.concatenate([met[q] for q in sorted(met)])
            out, ends = np.empty_like(state[-1]), np.append(first, len(l))
            for at in range(0, len(first), PRODUCT_ROWS):
                upto = min(at + PRODUCT_ROWS, len(first))
                a, b = ends[at], ends[upto]
                out[at:upto] = np.add.reduceat(l[a:b, None] * x[column[a:b]], first[at:upto] - a)
            return state, out

        def further(item: tuple) -> Iterator[tuple]:
            p, (met, parts) = item
            cells, sends = next(iter(parts))
            state, lx = product(met, cells)
            now = (lx - middle * state[-1]) / half
            return outgoing(p, (state[-1], now if len(state) == 1 else 2 * now - state[0]), sends)

        def last(item: tuple) -> tuple:
            p, (met, parts) = item
            state, lx = product(met, next(iter(parts))[0])
            return p, (state[-1], lx)

        moved = x.cogroup(self.parts, self.count).flatMap(begin).partitionBy(self.count)
        for _ in range(degree):
            moved = moved.cogroup(self.parts, self.count).flatMap(further).partitionBy(self.count)
        return moved.cogroup(self.parts, self.count).map(last, preservesPartitioning=True)


class _WholeCells(_Cells):
    """The same where tasks hold all cells: they share out the block's vectors instead, so that no product moves any. A round moves the block to them and, twice as large, back."""

    def _keep(self, rows: RDD) -> None:
        def part(item: tuple[int, tuple]) -> tuple:
            p, (first, l, column, needed) = item
            return p, (np.diff(first, append=len(l)).astype(np.int32), l, needed[column].astype(np.int32))

        packed = rows.map(part).persist(StorageLevel.MEMORY_AND_DISK)
        self.sizes = dict(packed.map(lambda x: (x[0], len(x[1][0]))).collect())
        self.top = packed.map(lambda x: float(np.add.reduceat(np.abs(x[1][1]), np.cumsum(x[1][0]) - x[1][0]).max())).max()
        self.packed, self.dealt = packed, {}
        rows.unpersist()

    def degree(self, low: float, cut: float) -> int:
        """As high as rounding bears, as products are cheap: vectors at low grow at most APART times as much as those at cut."""
        reach = np.arccosh(max((self.top + cut - 2 * low) / max(self.top - cut, 1e-300), 1 + 1e-12))
        return int(np.clip(np.log(2 * APART) / reach, DEGREE, MOST_DEGREE))

    def start(self, m: int) -> RDD:
        sizes = self.sizes
        return self.context.parallelize(sorted(sizes), self.count).map(lambda p: (p, (np.random.default_rng([0, p]).normal(size=(sizes[p], m)),)))

    def _cells_for(self, groups: int) -> RDD:
        """All cells, once for each group of vectors."""
        if groups not in self.dealt:
            def whole(found: Iterable) -> tuple[np.ndarray, ...]:
                found = [x for _, x in sorted(found, key=lambda x: x[0])]
                counts, l, column = (np.concatenate([x[k] for x in found]) for k in range(3))
                return np.cumsum(counts, dtype=np.int64) - counts, l, column

            self.dealt[groups] = self.packed.flatMap(lambda x: ((g, x) for g in range(groups))).groupByKey(groups).mapValues(whole).persist(StorageLevel.MEMORY_AND_DISK)
        return self.dealt[groups]

    def filtered_products(self, x: RDD, middle: float, half: float, degree: int) -> RDD:
        bounds, m = self.bounds, self.width
        groups = -(-m // -(-m // self.context.defaultParallelism))
        cuts = np.linspace(0, m, groups + 1).astype(int)

        def product(cells: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
            first, l, column = cells
            out, ends, at = np.empty_like(x), np.append(first, len(l)), 0
            while at < len(x):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + PRODUCT_CELLS, "right")) - 1)
                a, b = ends[at], ends[upto]
                out[at:upto] = np.add.reduceat(l[a:b] * x[column[a:b]], first[at:upto] - a)
                at = upto
            return out

        def filtered(item: tuple) -> Iterator[tuple]:
            g, (met, cells) = item
            cells = next(iter(cells))
            x = np.concatenate([v for _, v in sorted(next(iter(met)), key=lambda v: v[0])], axis=1)
            both = []
            for before in x:
                now, lx = before, product(cells, before)
                for step in range(degree):
                    at = (lx - middle * now) / half
                    before, now = now, at if step == 0 else 2 * at - before
                    lx = product(cells, now)
                both.append((now, lx))
            for p in range(len(bounds) - 1):
                some = slice(bounds[p], bounds[p + 1])
                yield p, (g, np.stack([[y[some], ly[some]] for y, ly in both]))

        def back(found: Iterable) -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate([v for _, v in sorted(found, key=lambda v: v[0])])
            return np.ascontiguousarray(found[:, 0].T), np.ascontiguousarray(found[:, 1].T)

        columns = x.flatMap(lambda item: ((g, (item[0], item[1][-1].T[cuts[g] : cuts[g + 1]])) for g in range(groups))).groupByKey(groups)
        return columns.cogroup(self._cells_for(groups), groups).flatMap(filtered).groupByKey(self.count).mapValues(back)

    def close(self) -> None:
        for cells in (self.packed, *self.dealt.values()):
            cells.unpersist()


def _basis_of(gram: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and the turn to their orthonormal vectors, of X'X and X'LX."""
    scale = 1 / np.sqrt(np.diag(gram))
    sizes, basis = np.linalg.eigh(gram * scale[:, None] * scale)
    turn = scale[:, None] * basis / np.sqrt(np.maximum(sizes, 1e-14 * sizes[-1]))
    values, inner = np.linalg.eigh(turn.T @ (product + product.T) @ turn / 2)
    return values, turn @ inner


def _smallest(cells: _Cells, k: int) -> tuple[np.ndarray, RDD]:
    """The k smallest eigenvalues, equal ones included, and (part, vectors), by rounds of filtering a block and solving in its span.

    A round is one job; only sums of products of the block's vectors reach the driver.
    """
    m = cells.width = min(cells.n, k + max(SPARE, k // 2))
    pairs, kept = cells.filtered_products(cells.start(m), 0.0, 1.0, 0), None
    for _ in range(ROUNDS):
        pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
        pairs.checkpoint()
        gram, product = pairs.map(lambda x: np.stack([x[1][0].T @ x[1][0], x[1][0].T @ x[1][1]])).treeReduce(np.add)
        if kept is not None:
            kept.unpersist()
        kept = pairs
        values, turn = _basis_of(gram, product)

        def apart(x: tuple, values: np.ndarray = values[:k], turn: np.ndarray = turn[:, :k]) -> np.ndarray:
            return np.sum((x[1][1] @ turn - x[1][0] @ turn * values) ** 2, axis=0)

        if np.sqrt(pairs.map(apart).treeReduce(np.add).max()) <= TOLERANCE:
            return values[:k], pairs.mapValues(lambda x, turn=turn[:, :k]: x[0] @ turn)
        turned = pairs.mapValues(lambda x, turn=turn: (x[0] @ turn,))
        pairs = cells.filtered_products(turned, (cells.top + values[-1]) / 2, (cells.top - values[-1]) / 2, cells.degree(values[0], values[-1]))
        cells.context._jvm.System.gc()  # shuffles of earlier rounds are cleaned when their jobs are forgotten
    raise RuntimeError(f"{k} eigenvectors of {cells.n} nodes are unfinished after {ROUNDS} rounds")


def eigenvectors(laplacian: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, k smallest eigenvalues ascending, eigenvectors) of symmetric cells (src, dst, l).

    Up to MAX_DENSE nodes in one dense solve; beyond it cells and vectors stay distributed until the k found ones are returned.
    Tasks multiply vectors of their own where they can hold all cells (WHOLE_BYTES), and rows of their own beyond that.
    """
    laplacian = cut_lineage(laplacian)  # once: neighbours of all pairs may stand behind it
    n = laplacian.select("src").distinct().count()
    if not 1 <= k <= n - 1:
        raise ValueError(f"k must be in 1..{n - 1}")
    if n * 8 * (k + 1) > MAX_BASIS_BYTES:
        raise ValueError(f"{n} nodes are more than the driver may hold")
    nodes = laplacian.select("src").distinct().orderBy("src").toArrow().column("src").to_numpy()
    if n > MAX_DENSE:
        cells = (_WholeCells if 12 * laplacian.count() <= WHOLE_BYTES else _Cells)(laplacian, nodes)
        values, parts = _smallest(cells, k)
        vectors = np.concatenate([v for _, v in sorted(parts.collect(), key=lambda x: x[0])])  # once, k numbers a node
        cells.close()
        return nodes, values, fixed_signs(vectors)
    place = {x: i for i, x in enumerate(nodes.tolist())}
    dense = np.zeros((n, n))
    for r in laplacian.collect():  # sparse cells of at most MAX_DENSE nodes
        dense[place[r.src], place[r.dst]] = r.l
    values, vectors = np.linalg.eigh((dense + dense.T) / 2)
    return nodes, values[:k], fixed_signs(vectors[:, :k])


def basis_table(spark: SparkSession, nodes: np.ndarray, vectors: np.ndarray) -> DataFrame:
    bounds = np.arange(len(nodes) + 1, dtype=np.int32) * vectors.shape[1]
    return spark.createDataFrame(pa.table({"node": np.asarray(nodes, np.int64), "phi": pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ravel(vectors)))}))


def heat_kernel_signature(basis: DataFrame, values: np.ndarray, n_times: int = 8) -> DataFrame:
    """``(node, t_index, hks)``: sum of exp(-t l) phi^2 at times spaced by a constant factor."""
    live = values[values > 1e-10]
    live = live if len(live) else np.ones(1)  # as many parts as values: no time changes anything
    times = np.geomspace(4 * np.log(10) / live.max(), 4 * np.log(10) / live.min(), n_times)
    weights = [F.array(*[F.lit(float(w)) for w in np.exp(-t * values)]) for t in times]
    terms = [F.aggregate(F.zip_with("phi", w, lambda p, x: p * p * x), F.lit(0.0), lambda acc, x: acc + x) for w in weights]
    return basis.select("node", F.posexplode(F.array(*terms)).alias("t_index", "hks"))


def principal_angle_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False), 0, 1)


class Spectrum(NamedTuple):
    """What a functional map needs of one side: eigenvalues (k), coefficients of q descriptors (k x q) and their products in the basis (q x k x k)."""

    values: np.ndarray
    coefficients: np.ndarray
    products: np.ndarray


def spectrum_of(values: np.ndarray, phi: np.ndarray, f: np.ndarray) -> Spectrum:
    """Of a basis and descriptors in memory."""
    return Spectrum(values, phi.T @ f, np.einsum("ni,nq,nj->qij", phi, f, phi, optimize=True))


def _sums_by_descriptor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Added matrices of each descriptor."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for q, cells in zip(batch.column("q").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            totals[q] = np.frombuffer(cells) + totals.get(q, 0.0)
    if totals:
        yield pa.RecordBatch.from_pydict({"q": pa.array(list(totals), pa.int32()), "cells": [x.tobytes() for x in totals.values()]})


def distributed_spectrum(values: np.ndarray, basis: DataFrame, descriptors: DataFrame) -> Spectrum:
    """The same of tables, basis (node, phi) and descriptors (sample_id, v): sums of every task, added by descriptor; no row reaches the driver."""
    both = basis.join(descriptors.select(F.col("sample_id").alias("node"), F.col("v").cast("array<double>").alias("f")), "node").select("phi", "f")

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                phi, f = matrix(batch.column("phi")), matrix(batch.column("f"))
                found = np.stack([np.concatenate([(phi.T @ f[:, q])[None], (phi * f[:, [q]]).T @ phi]) for q in range(f.shape[1])])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"q": np.arange(len(total), dtype=np.int32), "cells": [x.tobytes() for x in total]})

    parts = both.mapInArrow(of_task, "q int, cells binary").repartition("q").mapInArrow(_sums_by_descriptor, "q int, cells binary")
    rows = sorted(parts.collect())
    cells = np.array([np.frombuffer(r.cells) for r in rows]).reshape(len(rows), len(values) + 1, len(values))
    return Spectrum(values, cells[:, 0].T, cells[:, 1:])


def functional_map(x: Spectrum, y: Spectrum, alpha: float = 1e-2, beta: float = 1e-2, tolerance: float = 1e-12, rounds: int = 2000) -> np.ndarray:
    """C (k_y x k_x) with C a ~ b for descriptor coefficients, commuting with Laplacians (alpha) and descriptor products (beta).

    Without beta the rows of C are systems of their own. With it the normal equations are solved by conjugate gradients that
    apply them to C as a matrix, with those systems (and what beta adds to each) as preconditioner: k_x^2 k_y numbers, never the square of k_x k_y.
    """
    a, b = x.coefficients, y.coefficients
    apart = alpha * (y.values[:, None] - x.values[None]) ** 2
    blocks = (a @ a.T)[None] + np.einsum("ij,jk->ijk", apart, np.eye(len(a)))
    if beta:
        own = np.einsum("qii->qi", y.products)
        squares = np.einsum("qij,qij->i", y.products, y.products)
        blocks = blocks + beta * (squares[:, None, None] * np.eye(len(a)) - 2 * np.einsum("qi,qjk->ijk", own, x.products) + np.einsum("qij,qjk->ik", x.products, x.products)[None])
    ridge = 1e-12 * np.einsum("ijj->", blocks) / (len(a) * len(b))
    factors = np.linalg.inv(blocks + ridge * np.eye(len(a)))

    def normal(c: np.ndarray) -> np.ndarray:
        out = (c @ a) @ a.T + apart * c + ridge * c
        for sx, sy in zip(x.products, y.products, strict=True) if beta else ():
            e = sy @ c - c @ sx
            out = out + beta * (sy @ e - e @ sx)
        return out

    right = b @ a.T
    c = np.einsum("ijk,ik->ij", factors, right)
    if not beta:
        return c
    residual = right - normal(c)
    z = np.einsum("ijk,ik->ij", factors, residual)
    step, energy, start = z, np.sum(residual * z), np.linalg.norm(right)
    for _ in range(rounds):
        if np.linalg.norm(residual) <= tolerance * start:
            break
        along = normal(step)
        t = energy / np.sum(step * along)
        c, residual = c + t * step, residual - t * along
        z = np.einsum("ijk,ik->ij", factors, residual)
        energy, before = np.sum(residual * z), energy
        step = z + energy / before * step
    return c


def map_similarity(c: np.ndarray) -> float:
    """Share of the energy of C'C on its diagonal; 1 for an isometry."""
    g = c.T @ c
    return float(np.sum(np.diag(g) ** 2) / max(np.sum(g**2), 1e-300))


def mapped_basis(basis_x: DataFrame, c: np.ndarray) -> DataFrame:
    """``(sample_id, v)``: rows of x's basis in y's, for a nearest-row search."""
    parts = [F.aggregate(F.zip_with("phi", F.array(*[F.lit(float(v)) for v in row]), lambda p, x: p * x), F.lit(0.0), lambda acc, x: acc + x) for row in c]
    return basis_x.select(F.col("node").alias("sample_id"), F.array(*parts).alias("v"))
