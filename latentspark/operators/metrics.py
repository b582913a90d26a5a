"""Scores of predicted vectors against targets. Tables are (sample_id, v)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.operators.align.base import check_paired
from latentspark.operators.blocks import matrix
from latentspark.operators.pairs import paired_ranks


def paired(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """``(sample_id, p, t)`` of rows on both sides; unequal tables are an error, as in fitting."""
    check_paired(predicted, targets)
    return predicted.select("sample_id", F.col("v").alias("p")).join(targets.select("sample_id", F.col("v").alias("t")), "sample_id")


def _column_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each column: rows, squared errors, energy, and mean and squared deviation of the target."""
    for batch in batches:
        if batch.num_rows:
            p, t = matrix(batch.column("p")), matrix(batch.column("t"))
            mean = t.mean(axis=0)
            yield pa.RecordBatch.from_pydict({"dim": np.arange(t.shape[1], dtype=np.int32), "n": np.full(t.shape[1], len(t)), "e": ((p - t) ** 2).sum(axis=0), "q": (t**2).sum(axis=0), "m": mean, "d": ((t - mean) ** 2).sum(axis=0)})


def reconstruction(both: DataFrame) -> DataFrame:
    """mse over elements, nmse against raw energy, r2 against centred variance, mean row cosine. both: (p, t)."""
    sides = both.select(F.col("p").cast("array<double>").alias("p"), F.col("t").cast("array<double>").alias("t"))
    parts = sides.mapInArrow(_column_parts, "dim int, n long, e double, q double, m double, d double")
    # A column's deviation is that within its parts and that of the parts' means.
    nm, nmm = F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m"))
    dims = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("q").alias("q"), (F.sum("d") + nmm - nm * nm / F.sum("n")).alias("c"))
    sums = dims.agg((F.sum("e") / F.sum("n")).alias("mse"), (F.sum("e") / F.sum("q")).alias("nmse"), (1 - F.sum("e") / F.sum("c")).alias("r2"))
    return sums.crossJoin(both.agg(F.avg(vec.cosine(F.col("p"), F.col("t"))).alias("cosine")))  # one row each


def retrieval(ranks: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """mrr and top-k shares of paired ranks."""
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"), *(F.avg((F.col("rank") <= k).cast("int")).alias(f"top{k}") for k in ks))


def first_argmax(v: Column) -> Column:
    """0-based place of the largest element, the first on ties."""
    return F.array_position(v, F.array_max(v)) - 1


def accuracy(rows: DataFrame, predicted: Column, native: Column, label: Column) -> DataFrame:
    """accuracy of predictions, that of the receiver's own (oracle), and their ratio."""
    out = rows.agg(F.avg((predicted == label).cast("int")).alias("accuracy"), F.avg((native == label).cast("int")).alias("oracle"))
    return out.withColumn("ratio", F.when(F.col("oracle") > 0, F.col("accuracy") / F.col("oracle")).otherwise(0.0))


def residual_r2(rows: DataFrame) -> DataFrame:
    """Share of the rigid residual that the full prediction explains; 0 without residual. rows: (rigid, full, t)."""
    s = rows.agg(F.sum(vec.sq_dist(F.col("full"), F.col("t"))).alias("left"), F.sum(vec.sq_dist(F.col("rigid"), F.col("t"))).alias("energy"))
    return s.select(F.when(F.col("energy") > 0, 1 - F.col("left") / F.col("energy")).otherwise(0.0).alias("residual_r2"))


def alignment(predicted: DataFrame, targets: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Reconstruction and retrieval in one row."""
    return reconstruction(paired(predicted, targets)).crossJoin(retrieval(paired_ranks(predicted, targets), ks))


def probed(probe, predicted: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """One row (accuracy, oracle, ratio) of a probe on predicted vectors and on the targets' own. targets: (sample_id, v, label)."""
    labelled = targets.where(F.col(label).isNotNull()).select("sample_id", "v", F.col(label).alias("label"))
    own = probe.classify(labelled).withColumnRenamed("predicted", "own")
    said = probe.classify(predicted.select("sample_id", "v"))
    return accuracy(own.join(said, "sample_id"), F.col("predicted"), F.col("own"), F.col("label"))
