"""Probes that read class labels from vectors: ridge from moments, and a small network."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.blocks import STRIP, column_sums, cut_lineage, matrix, moment_matrix
from latentspark.operators.linalg import relative_ridge


def _with_class(df: DataFrame, predict, vector: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (vector, "predicted")]
    schema = df.select(*kept, F.lit(0).cast("long").alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in kept}
            columns["predicted"] = pa.array(predict(matrix(batch.column("__v"))) if batch.num_rows else [], pa.int64())
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in schema.names})

    return df.select(*kept, F.col(vector).cast("array<double>").alias("__v")).mapInArrow(run, schema)


class RidgeProbe:
    """One-hot ridge with a free intercept; the first class wins ties. Fitted from sums and products alone."""

    def __init__(self, l2: float = 1e-6) -> None:
        self.l2 = l2

    def fit(self, df: DataFrame, label: str = "label", vector: str = "v") -> RidgeProbe:
        rows = df.where(F.col(label).isNotNull())
        moment = moment_matrix(rows, vector)
        n, d = moment[0, 0], len(moment) - 1
        sums = column_sums(rows, label, vector).collect()  # a row a class
        self.classes = np.array(sorted(r.key for r in sums))
        cross = np.zeros((d + 1, len(self.classes)))
        for r in sums:
            cross[:, np.searchsorted(self.classes, r.key)] = [r.n, *r.s]
        mean = moment[0, 1:] / n
        xx = moment[1:, 1:] - n * np.outer(mean, mean)
        self.w = np.linalg.solve(relative_ridge(xx, self.l2), cross[1:] - np.outer(mean, cross[0]))
        self.b = cross[0] / n - mean @ self.w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != len(self.w):
            raise ValueError(f"width {x.shape[1]} is not {len(self.w)}")
        return self.classes[(x @ self.w + self.b).argmax(axis=1)]

    def classify(self, df: DataFrame, vector: str = "v") -> DataFrame:
        """df with ``predicted`` in place of the vector."""
        return _with_class(df, self.predict, vector)


class MLPProbe:
    """Norm, dense, tanh, norm, dense; Adam with early stopping on a held-out part.

    Up to ``max_rows`` rows are learned on the driver. More stay where they are: in an epoch every task goes on from the same
    weights through its own rows, and what the tasks reach is averaged by their rows.
    """

    def __init__(self, hidden: int = 512, rate: float = 3e-3, epochs: int = 60, patience: int = 8, batch: int = 64, val_fraction: float = 0.15, max_rows: int = 20_000, seed: int = 0) -> None:
        self.hidden, self.rate, self.epochs, self.patience, self.batch, self.val_fraction, self.max_rows, self.seed = hidden, rate, epochs, patience, batch, val_fraction, max_rows, seed

    @staticmethod
    def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        std = np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
        return (x - x.mean(axis=1, keepdims=True)) / std, std

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        w1, b1, w2, b2 = self.weights
        a, _ = self._norm(x)
        h = np.tanh(a @ w1 + b1)
        c, std = self._norm(h)
        z = c @ w2 + b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return a, h, c, std, p / p.sum(axis=1, keepdims=True)

    def fit(self, df: DataFrame, label: str = "label", vector: str = "v") -> MLPProbe:
        # Kept before the filter, which would carry a made label's whole expression down to the scan.
        named = cut_lineage(df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("y"), "sample_id")).where("y IS NOT NULL")
        if named.count() > self.max_rows:
            return self._fit_table(named)
        rows = named.orderBy("sample_id").collect()
        x, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
        self.classes, y = np.unique(y, return_inverse=True)
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        n_val = max(1, round(self.val_fraction * len(x)))
        val, rest = order[:n_val], order[n_val:]
        self._start(rng, x.shape[1])
        return self._stopped_early(lambda: self._epoch(x, y, rng.permutation(rest)), lambda: self._loss(x[val], y[val]) / len(val))

    def _fit_table(self, rows: DataFrame) -> MLPProbe:
        self.classes = classes = np.array([r.y for r in rows.select("y").distinct().orderBy("y").collect()])  # a row a class
        context, seed = rows.sparkSession.sparkContext, self.seed

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    y = np.searchsorted(classes, np.array(batch.column("y").to_pylist()))
                    yield pa.RecordBatch.from_pydict({"x": [matrix(batch.column("v")).tobytes()], "y": [y.astype(np.int64).tobytes()]})

        width = rows.select(F.size("v")).first()[0]
        share = F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(10_000)) < round(self.val_fraction * 10_000)

        def parts_of(some: DataFrame) -> RDD:
            # One part for each task that can run at once; which rows a task has depends on their ids alone.
            lying = cut_lineage(some.repartition(context.defaultParallelism, "sample_id").sortWithinPartitions("sample_id").mapInArrow(packed, "x binary, y binary"))
            whole = lying.rdd.map(lambda r: (np.frombuffer(r.x).reshape(-1, width), np.frombuffer(r.y, np.int64)))
            return whole.mapPartitionsWithIndex(lambda k, found: [(k, *(np.concatenate(c) for c in zip(*found, strict=True)))] if (found := list(found)) else []).persist()

        val, rest = parts_of(rows.where(share)), parts_of(rows.where(~share))
        self._start(np.random.default_rng(seed), width)
        epochs = [0]

        def epoch() -> None:
            sent, at = context.broadcast(self), epochs[0]

            def of_part(part: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, int, list[np.ndarray]]:
                k, x, y = part
                probe = copy.deepcopy(sent.value)
                probe._epoch(x, y, np.random.default_rng([seed, at, k]).permutation(len(x)))
                return len(x), len(x) * probe.step, [len(x) * w for w in (*probe.weights, *probe.first, *probe.second)]

            n, steps, sums = rest.map(of_part).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], [p + q for p, q in zip(a[2], b[2], strict=True)]))
            means, m = [w / n for w in sums], len(self.weights)
            self.weights, self.first, self.second, self.step = means[:m], means[m : 2 * m], means[2 * m :], round(steps / n)
            epochs[0] += 1
            sent.unpersist()

        def loss() -> float:
            sent = context.broadcast(self)
            total, n = val.map(lambda p: np.array([sent.value._loss(p[1], p[2]), len(p[1])])).treeReduce(lambda a, b: a + b)
            sent.unpersist()
            return total / n

        self._stopped_early(epoch, loss)
        val.unpersist()
        rest.unpersist()
        return self

    def _start(self, rng: np.random.Generator, d: int) -> None:
        k = len(self.classes)
        self.weights = [rng.normal(size=(d, self.hidden)) / np.sqrt(d), np.zeros(self.hidden), rng.normal(size=(self.hidden, k)) / np.sqrt(self.hidden), np.zeros(k)]
        self.first, self.second, self.step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0

    def _epoch(self, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> None:
        for some in np.array_split(order, max(1, len(order) // self.batch)):
            a, h, c, std, p = self._forward(x[some])
            p[np.arange(len(some)), y[some]] -= 1
            back = p / len(some)
            dc = back @ self.weights[2].T
            dh = (dc - dc.mean(axis=1, keepdims=True) - c * (dc * c).mean(axis=1, keepdims=True)) / std * (1 - h**2)
            self.step += 1
            for i, g in enumerate((a.T @ dh, dh.sum(0), c.T @ back, back.sum(0))):
                self.first[i] = 0.9 * self.first[i] + 0.1 * g
                self.second[i] = 0.999 * self.second[i] + 0.001 * g**2
                self.weights[i] = self.weights[i] - self.rate * self.first[i] / (1 - 0.9**self.step) / (np.sqrt(self.second[i] / (1 - 0.999**self.step)) + 1e-8)

    def _loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Summed over rows, a strip at a time."""
        total = 0.0
        for at in range(0, len(x), STRIP):
            total -= float(np.log(np.maximum(self._forward(x[at : at + STRIP])[-1][np.arange(len(x[at : at + STRIP])), y[at : at + STRIP]], 1e-12)).sum())
        return total

    def _stopped_early(self, epoch: Callable[[], None], loss: Callable[[], float]) -> MLPProbe:
        best, left, kept = np.inf, self.patience, list(self.weights)
        for _ in range(self.epochs):
            epoch()
            now = loss()
            if now < best - 1e-5:
                best, left, kept = now, self.patience, list(self.weights)
            else:
                left -= 1
                if not left:
                    break
        self.weights = kept
        del self.first, self.second, self.step
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self._forward(x)[-1].argmax(axis=1)]

    def classify(self, df: DataFrame, vector: str = "v") -> DataFrame:
        return _with_class(df, self.predict, vector)


PROBES = {"ridge": RidgeProbe, "mlp": MLPProbe}


def build_probe(kind: str, df: DataFrame, label: str = "label", vector: str = "v", **settings) -> RidgeProbe | MLPProbe:
    """A fitted probe by name; rows of more than one width are an error before any is fitted."""
    if kind not in PROBES:
        raise ValueError(f"unknown probe {kind!r}")
    least, most = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least is None or least != most:
        raise ValueError(f"vectors of {least} to {most} numbers")
    return PROBES[kind](**settings).fit(df, label, vector)
