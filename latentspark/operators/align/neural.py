"""Neural maps: one small network on the target, or on what a rigid map leaves.

A network is fitted by L-BFGS, whose value and gradient are sums over rows. Up to ``max_points`` pilots
are summed on the driver. More stay where they are: each step is one pass that sends the weights to the tasks
and adds what they return, a value and a gradient each, beyond ``FEW_TASKS`` in two levels, so that neither one task nor
the driver receives more than about the root of their number. Both ways minimise the same function from the same start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.align.base import Aligner
from latentspark.operators.align.linear import procrustes
from latentspark.operators.blocks import cut_lineage, map_vectors, matrix, moment_matrix
from latentspark.operators.linalg import lbfgs

#: Rows of a task's sums that are worked on at a time.
STRIP = 2048
#: Tasks whose sums the driver takes as they are.
FEW_TASKS = 16


class Network:
    """Dense layers with tanh between, fitted by L-BFGS with a weight penalty."""

    def __init__(self, hidden: tuple[int, ...] = (16,), alpha: float = 0.1, rounds: int = 200, seed: int = 0) -> None:
        self.hidden, self.alpha, self.rounds, self.seed = hidden, alpha, rounds, seed

    def _unpacked(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def sums(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the squared error of rows and its gradient."""
        layers, outs = self._unpacked(flat), [x]
        for k, (w, b) in enumerate(layers):
            z = outs[-1] @ w + b
            outs.append(np.tanh(z) if k < len(layers) - 1 else z)
        back = outs[-1] - y
        value, grads = 0.5 * float(np.sum(back**2)), []
        for k in range(len(layers) - 1, -1, -1):
            w = layers[k][0]
            grads.append(np.concatenate([(outs[k].T @ back).ravel(), back.sum(axis=0)]))
            back = (back @ w.T) * (1 - outs[k] ** 2) if k else back
        return value, np.concatenate(grads[::-1])

    def minimise(self, width: int, height: int, n: int, sums: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> Network:
        """From the sums over n rows of a width by a function of the weights."""
        self.sizes = [width, *self.hidden, height]
        rng = np.random.default_rng(self.seed)
        start = [np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(self.sizes, self.sizes[1:], strict=False)]

        def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
            value, gradient = sums(flat)
            penalty = np.concatenate([np.concatenate([w.ravel(), np.zeros(len(b))]) for w, b in self._unpacked(flat)])
            return (value + 0.5 * self.alpha * float(penalty @ penalty)) / n, (gradient + self.alpha * penalty) / n

        self.flat = lbfgs(loss, np.concatenate(start), self.rounds)
        self.loss = loss(self.flat)[0]
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        return self.minimise(x.shape[1], y.shape[1], len(x), lambda flat: self.sums(flat, x, y))

    def fit_table(self, both: DataFrame, n: int) -> Network:
        """From n rows (x, y) of a table."""
        first = both.select(F.size("x"), F.size("y")).first()
        context = both.sparkSession.sparkContext
        # Rows lie as matrices, as many parts as tasks can run at once, and are read by a step without a plan of its own.
        packed = cut_lineage(both.select("x", "y").repartition(context.defaultParallelism).mapInArrow(_strips, "x binary, y binary"))
        parts = packed.rdd.map(lambda r: (np.frombuffer(r.x).reshape(-1, first[0]), np.frombuffer(r.y).reshape(-1, first[1]))).persist()

        def sums(flat: np.ndarray) -> tuple[float, np.ndarray]:
            sent = context.broadcast((self, flat))

            def of_rows(strips: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray]]:
                network, weights = sent.value
                value, gradient = 0.0, np.zeros(len(weights))
                for x, y in strips:
                    more = network.sums(weights, x, y)
                    value, gradient = value + more[0], gradient + more[1]
                yield value, gradient

            tasks = parts.mapPartitions(of_rows)
            many = tasks.getNumPartitions()
            if many > FEW_TASKS:  # added in two levels
                tasks = tasks.repartition(math.isqrt(many)).mapPartitions(_added)
            found = tasks.collect()
            sent.unpersist()
            return sum(value for value, _ in found), np.sum([gradient for _, gradient in found], axis=0)

        self.minimise(*first, n, sums)
        parts.unpersist()
        return self

    def __call__(self, z: np.ndarray) -> np.ndarray:
        layers = self._unpacked(self.flat)
        for k, (w, b) in enumerate(layers):
            z = z @ w + b
            z = np.tanh(z) if k < len(layers) - 1 else z
        return z


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STRIP):
            part = batch.slice(at, STRIP)
            yield pa.RecordBatch.from_pydict({c: [matrix(part.column(c)).astype(float).tobytes()] for c in ("x", "y")})


def _added(found: Iterator[tuple[float, np.ndarray]]) -> Iterator[tuple[float, np.ndarray]]:
    total = None
    for value, gradient in found:
        total = (value, gradient) if total is None else (total[0] + value, total[1] + gradient)
    if total is not None:
        yield total


class DirectMLPAligner(Aligner):
    needs_rows = True
    fits_tables = True

    def __init__(self, hidden: tuple[int, ...] = (16,), alpha: float = 0.1, rounds: int = 200, seed: int = 0, **chart) -> None:
        super().__init__(**chart)
        self.network = Network(hidden, alpha, rounds, seed)

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.network.fit(x, y)

    def _fit_table(self, both: DataFrame) -> None:
        both = cut_lineage(both)
        self.n_pilots = both.count()
        self.network.fit_table(both, self.n_pilots)

    def _map(self, z: np.ndarray) -> np.ndarray:
        return self.network(z)

    @property
    def map_parameters(self) -> int:
        return self.network.flat.size


class ResidualMLPAligner(DirectMLPAligner):
    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        self.q = procrustes(x.T @ y, 1.0)[0]
        self.network.fit(x, y - x @ self.q.T)

    def _fit_table(self, both: DataFrame) -> None:
        both = cut_lineage(both)
        moment, d = moment_matrix(both, "x", "y"), self.src.out_dim
        self.n_pilots = int(moment[0, 0])
        self.q = q = procrustes(moment[1 : 1 + d, 1 + d :], 1.0)[0]
        left = map_vectors(both.select("x", F.concat("x", "y").alias("y")), lambda xy: xy[:, d:] - xy[:, :d] @ q.T, "y", "y")
        self.network.fit_table(cut_lineage(left), self.n_pilots)

    def _map(self, z: np.ndarray) -> np.ndarray:
        return z @ self.q.T + self.network(z)

    @property
    def map_parameters(self) -> int:
        return self.network.flat.size + self.q.size

    def apply_linear(self, x: np.ndarray) -> np.ndarray:
        """The rigid stage alone."""
        return self.tgt.invert(self.src.apply(x) @ self.q.T)

    def transform_linear(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return map_vectors(df, self.apply_linear, vector, vector)
