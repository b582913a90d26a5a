"""Column statistics and reshaping of embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.operators.blocks import map_vectors, moment_matrix
from latentspark.operators.linalg import fixed_signs


def long_form(df: DataFrame, vector: str = "v", keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """A row ``(keep..., dim, value)`` for each element."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "value"))


def column_stats(df: DataFrame, vector: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., dim, n, mean, std, least, most)``; std divides by n."""
    return long_form(df, vector, by).groupBy(*by, "dim").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"),
    )


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str = "v", out: str = "centroid") -> DataFrame:
    """Mean vector of each group, summed on the map side."""
    means = long_form(df, vector, by).groupBy(*by, "dim").agg(F.avg("value").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(out))


def standardised(df: DataFrame, method: str, vector: str = "v") -> DataFrame:
    """df with its vectors l2-normalised, centred or standardised (a deviation of 0 divides by 1)."""
    if method == "l2":
        return df.withColumn(vector, vec.unit(F.col(vector)))
    if method not in ("center", "standard"):
        raise ValueError(f"unknown method {method!r}")
    stats = column_stats(df, vector).orderBy("dim").collect()  # one row a dimension
    mean = F.array(*[F.lit(float(r["mean"])) for r in stats])
    centred = vec.minus(F.col(vector), mean)
    if method == "center":
        return df.withColumn(vector, centred)
    std = F.array(*[F.lit(float(r["std"]) or 1.0) for r in stats])
    return df.withColumn(vector, F.zip_with(centred, std, lambda x, s: x / s))


def similarity_features(df: DataFrame, anchors: Sequence[Sequence[float]], similarity: str = "cosine", vector: str = "v", parseval: bool = False) -> DataFrame:
    """Each vector as its similarities to a fixed, small list of anchors (cosine, inner, or descriptor = 1 - cosine).

    parseval replaces the anchors by their nearest Parseval frame first.
    """
    if similarity not in ("cosine", "inner", "descriptor"):
        raise ValueError(f"unknown similarity {similarity!r}")
    if parseval:
        u, _, vt = np.linalg.svd(np.asarray(anchors, float), full_matrices=False)
        anchors = (u @ vt).tolist()
    parts = []
    for a in anchors:
        anchor = F.array(*[F.lit(float(x)) for x in a])
        s = vec.dot(F.col(vector), anchor) if similarity == "inner" else vec.cosine(F.col(vector), anchor)
        parts.append(1 - s if similarity == "descriptor" else s)
    return df.withColumn(vector, F.array(*parts))


def class_spread(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """One row: total, within-class and between-class sums of squares."""
    cells = long_form(df, vector, [label]).groupBy(label, "dim").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    dims = cells.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"))
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return dims.agg(F.sum(total).alias("total"), F.sum("within").alias("within"), F.sum(total - F.col("within")).alias("between"))


def covariance(moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of the columns behind a moment matrix."""
    n, mean = moment[0, 0], moment[0, 1:] / moment[0, 0]
    return mean, moment[1:, 1:] / n - np.outer(mean, mean)


def components(df: DataFrame, k: int, vector: str = "v") -> tuple[DataFrame, np.ndarray]:
    """Scores of the rows on k leading centred directions, and their singular values; k is at most n-1 and the width."""
    moment = moment_matrix(df, vector)
    n = int(moment[0, 0])
    mean, cov = covariance(moment)
    values, basis = np.linalg.eigh(cov)
    k = max(1, min(k, n - 1, len(mean)))
    basis = fixed_signs(basis[:, ::-1][:, :k])
    return map_vectors(df, lambda x: (x - mean) @ basis, vector, vector), np.sqrt(np.maximum(values[::-1][:k], 0) * n)
