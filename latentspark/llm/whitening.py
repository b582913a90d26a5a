"""Whitening of embeddings by the eigenvectors of their covariance.

An entry c becomes the integer x = floor(64 c) + 1,000,000. Sums of integers are
exact, and so is n x - S, n times a row's distance from the mean: rows are centred
before anything is multiplied, whatever the common offset. The rows (n x - S) / n are an
MLlib ``RowMatrix``, whose ``computeGramianMatrix`` sums width x width numbers in a tree
over tasks; divided by n it is the covariance. Its eigenvectors are found on the driver, and
the whitening matrix (width x components) is broadcast to ``mapInPandas``. The covariance
of the whitened rows, centred by their own mean, is taken the same way, for ``identity_error``.

No row is shuffled: tables are read four times (sums, covariance, mean and covariance of
the whitened rows) and once more for the result, and tasks return moments.

Defined cases: a vector that is null, empty or holds a null or non-finite entry is left
out; vectors of more than one width are an error, and so is an entry beyond 2^40 / 64; null and repeated ids
are rows like others; a component whose eigenvalue is within rounding of zero (at most width x 2^-52
of the largest) has a null ``whitened`` and no part in ``identity_error``, which is null where no component has more;
``explained`` is 0 where all vectors are equal; ``deviation`` is null where it doesn't fit a long; a table without
vectors gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.plans.shipping import ensure_importable

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries of at most this size keep sums of 2^20 rows and more exact.
MOST = float(2**40 / SCALE)
WHITENED = "vec_id long, n long, deviation long, whitened array<double>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitener:
    """n and S of the fit list, eigenvalues by falling size, and the matrix that whitens centred rows (NaN without a scale)."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    matrix: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = self.eigenvalues.sum()
        return self.eigenvalues / trace if trace > 0 else np.zeros_like(self.eigenvalues)


def integer_rows(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the vectors that count."""
    finite = F.forall("v", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    entry = lambda c: F.when(F.abs(c) <= MOST, F.floor(c * SCALE) + OFFSET).otherwise(F.raise_error(F.lit("an entry is too large to be summed exactly")).cast("long"))
    return rows.select("vec_id", F.transform("v", entry).alias("x"))


def exact_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension; of no rows (0, empty)."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return 0, np.zeros(0, np.int64)
    width = first[0]
    one_width = F.min(F.when(F.size("x") == width, 1).otherwise(0))
    n, same, *sums = rows.agg(F.count("*"), one_width, *(F.sum(F.get("x", F.lit(i))) for i in range(width))).first()
    if not same:
        raise ValueError("vectors have more than one width")
    return n, np.array(sums, np.int64)


def gramian(rows: DataFrame, entries: Column, n: int, width: int) -> np.ndarray:
    """Sum of the outer products of arrays of doubles, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(entries).alias("row")), "row")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray()


def _longs(values: np.ndarray) -> Column:
    return F.array(*(F.lit(int(v)) for v in values))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of integer rows; None of no rows."""
    n, sums = exact_sums(rows)
    if n == 0:
        return None
    centred = F.zip_with("x", _longs(sums), lambda x, s: (x * n - s) / F.lit(float(n)))
    values, vectors = np.linalg.eigh(gramian(rows, centred, n, len(sums)) / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    with np.errstate(divide="ignore"):
        scale = np.where(values > values[0] * len(values) * 2.0**-52, 1 / np.sqrt(values), np.nan)
    return Whitener(n, sums, values, (vectors * scale)[:, :components])


def _deviations(scaled: np.ndarray) -> list[int | None]:
    """Exact sums of squares of integers, a row each."""
    if float(np.abs(scaled).max(initial=0)) ** 2 * scaled.shape[1] < 2.0**62:
        return (scaled * scaled).sum(1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in scaled]
    return [d if d < 2**63 else None for d in exact]


def transform(rows: DataFrame, fitted: Broadcast[Whitener]) -> DataFrame:
    """Whitened rows; components without a scale are NaN in the list."""
    ensure_importable(rows.sparkSession)

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = fitted.value
        for batch in batches:
            scaled = np.stack(batch["x"].to_list()) * w.n - w.sums if len(batch) else np.zeros((0, len(w.sums)), np.int64)
            deviation = pd.Series(_deviations(scaled), dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "n": w.n, "deviation": deviation, "whitened": list(scaled / w.n @ w.matrix)})

    return rows.mapInPandas(whiten, WHITENED)


def identity_error(whitened: DataFrame, fitted: Whitener) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components that have a scale."""
    use = np.flatnonzero(np.isfinite(fitted.matrix).all(0))
    if not len(use):
        return None
    entry = lambda i: F.get("whitened", F.lit(int(i)))
    means = whitened.agg(*(F.avg(entry(i)) for i in use)).first()
    centred = F.array(*(entry(i) - F.lit(m) for i, m in zip(use, means, strict=True)))
    return float(np.abs(gramian(whitened, centred, fitted.n, len(use)) / fitted.n - np.eye(len(use))).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, vector)
    fitted = fit(rows, components)
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    whitened = transform(rows, spark.sparkContext.broadcast(fitted))
    error = identity_error(whitened, fitted)
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    explained = F.array(*(F.lit(float(e)) for e in fitted.explained))
    return whitened.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", value.alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
