"""Synthetic agents: one hidden ground truth, seen by each agent through its own distortion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def agent_name(k: int) -> str:
    return f"agent_{k:02d}"


def synthetic_agents(spark: SparkSession, n_agents: int, n_train: int, n_test: int, n_classes: int = 5, ground_dim: int = 8, agent_dims: Sequence[int] = (12, 16), scale_range: tuple[float, float] = (0.5, 2.0), noise_std: float = 0.05, class_sep: float = 3.0, anisotropy: float = 0.3, power_range: tuple[float, float] = (0.8, 1.25), seed: int = 0) -> DataFrame:
    """``(agent, split, sample_id, label, v)``. Each row comes from its own seeded stream, so any partitioning gives the same table."""
    if min(agent_dims) < ground_dim:
        raise ValueError("agents must be at least as wide as the ground truth")
    rng = np.random.default_rng(seed)
    centroids = rng.normal(size=(n_classes, ground_dim)) * class_sep
    agents = []
    for k in range(n_agents):
        d = agent_dims[k % len(agent_dims)]
        frame = np.linalg.qr(rng.normal(size=(d, ground_dim)))[0]
        agents.append((np.exp(anisotropy * rng.normal(size=ground_dim)), frame, rng.uniform(*scale_range), rng.uniform(*power_range)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("agent", "split", "sample_id", "label", "v")}
            for i in batch.column("id").to_pylist():
                own = np.random.default_rng((seed, 1, i))
                label = int(own.integers(n_classes))
                ground = centroids[label] + own.normal(size=ground_dim)
                for k, (stretch, frame, scale, power) in enumerate(agents):
                    x = scale * (frame @ (stretch * ground))
                    x = np.sign(x) * np.abs(x) ** power + noise_std * own.normal(size=len(x))
                    for c, value in zip(rows, (agent_name(k), "train" if i < n_train else "test", i, label, x), strict=True):
                        rows[c].append(value)
            yield pa.RecordBatch.from_pydict({"agent": rows["agent"], "split": rows["split"], "sample_id": pa.array(rows["sample_id"], pa.int64()), "label": pa.array(rows["label"], pa.int32()), "v": pa.array(rows["v"], pa.list_(pa.float64()))})

    return spark.range(n_train + n_test).mapInArrow(make, "agent string, split string, sample_id long, label int, v array<double>")
