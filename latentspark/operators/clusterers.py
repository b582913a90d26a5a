"""A door for clusterers: what a clusterer must say to run over a table of any size.

``start`` makes a state from a bounded draw of rows; in each round every task folds its batches into a part
(``partial``, ``merge``), parts are merged in two levels, and ``finish`` turns the whole into the next state, until it says
that it is done. ``assign`` gives each row its cluster, or ``NOISE``. States and parts are
small: they go to and from every task. Rows are passed once a round and stay where they are.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions.kernels import by_hash, sq_dists
from latentspark.operators.align.anchors import lloyd
from latentspark.operators.blocks import cut_lineage, map_vectors, matrix
from latentspark.plans.shipping import ensure_importable

#: The cluster of rows that a clusterer leaves out.
NOISE = -1
#: Rows, by hash, that a clusterer starts from.
START_ROWS = 2048
PART = "part binary"


class Clusterer(Protocol):
    """Rows are matrices, a row each."""

    rounds: int

    def start(self, rows: np.ndarray) -> Any: ...

    def partial(self, state: Any, rows: np.ndarray) -> Any: ...

    def merge(self, one: Any, other: Any) -> Any: ...

    def finish(self, state: Any, part: Any) -> tuple[Any, bool]: ...

    def assign(self, state: Any, rows: np.ndarray) -> np.ndarray: ...


class Lloyd:
    """k-means: a state is the centres, a part the counts and sums by centre."""

    def __init__(self, k: int, rounds: int = 50, seed: int = 0, tolerance: float = 1e-9) -> None:
        self.k, self.rounds, self.seed, self.tolerance = k, rounds, seed, tolerance

    def start(self, rows: np.ndarray) -> np.ndarray:
        group = lloyd(rows, min(self.k, len(rows)), self.seed)
        return np.array([rows[group == j].mean(axis=0) for j in np.unique(group)])

    def partial(self, state: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = self.assign(state, rows)
        rows, label = rows[label != NOISE], label[label != NOISE]
        sums = np.zeros_like(state)
        np.add.at(sums, label, rows)
        return np.bincount(label, minlength=len(state)), sums

    def merge(self, one, other):
        return one[0] + other[0], one[1] + other[1]

    def finish(self, state: np.ndarray, part) -> tuple[np.ndarray, bool]:
        n, sums = part
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], state)
        return moved, bool(np.abs(moved - state).max() <= self.tolerance)

    def assign(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return sq_dists(rows, state).argmin(axis=1)


class TrimmedLloyd(Lloyd):
    """k-means that leaves out rows farther than ``reach`` from every centre."""

    def __init__(self, k: int, reach: float, **settings) -> None:
        super().__init__(k, **settings)
        self.reach = reach

    def assign(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = sq_dists(rows, state)
        return np.where(d.min(axis=1) <= self.reach**2, d.argmin(axis=1), NOISE)


def _merged(clusterer: Clusterer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = None
    for batch in batches:
        for raw in batch.column("part").to_pylist():
            part = pickle.loads(raw)
            whole = part if whole is None else clusterer.merge(whole, part)
    if whole is not None:
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(whole)]})


def clustered(df: DataFrame, clusterer: Clusterer, seed: int = 0) -> DataFrame:
    """df (sample_id, v, ...) with ``cluster`` (int; NOISE for rows left out). A table without rows comes back without any."""
    ensure_importable(df.sparkSession)
    context = df.sparkSession.sparkContext
    vectors = cut_lineage(df.select("sample_id", F.col("v").cast("array<double>").alias("v")))
    first = [r.v for r in vectors.orderBy(by_hash(vectors, seed), "sample_id").limit(START_ROWS).collect()]
    if not first:
        return df.withColumn("cluster", F.lit(None).cast("int")).limit(0)
    state = clusterer.start(np.array(first))
    level = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    for _ in range(clusterer.rounds):
        shared = context.broadcast(state)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = None
            for batch in batches:
                if batch.num_rows:
                    part = clusterer.partial(shared.value, matrix(batch.column("v")))
                    whole = part if whole is None else clusterer.merge(whole, part)
            if whole is not None:
                yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(whole)]})

        parts = vectors.select("v").mapInArrow(fold, PART)
        if level > 1:
            parts = parts.repartition(level).mapInArrow(lambda batches: _merged(clusterer, batches), PART)
        found = [pickle.loads(r.part) for r in parts.collect()]
        whole = found[0]
        for part in found[1:]:
            whole = clusterer.merge(whole, part)
        state, done = clusterer.finish(state, whole)
        if done:
            break
    last = context.broadcast(state)
    told = map_vectors(df.withColumn("_row", F.col("v")), lambda x: clusterer.assign(last.value, x)[:, None].astype(float), "_row", "_cluster")
    return told.withColumn("cluster", F.col("_cluster")[0].cast("int")).drop("_cluster")
