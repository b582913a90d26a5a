"""The contract of maps: fit on paired rows, apply to any table or stream of vectors.

Scalers and linear maps are fitted from distributed moments. Kernel, anchor and
neural maps need the pilots themselves; these are a calibration set whose size is
a budget, and what reaches the driver is bounded: more than ``max_points`` of them
are an error for kernel and anchor maps, and are fitted where they are by neural ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.blocks import map_vectors, matrix, moment_matrix
from latentspark.operators.scaling import Scaler

MAX_POINTS = 4000


def check_paired(src: DataFrame, tgt: DataFrame) -> int:
    """Rows of two tables that hold the same ids, once each; anything else is an error. One pass over both."""
    sides = src.select("sample_id", F.lit(1).alias("left"), F.lit(0).alias("right")).union(tgt.select("sample_id", F.lit(0).alias("left"), F.lit(1).alias("right")))
    met = sides.groupBy("sample_id").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    n, off = met.agg(F.count("*"), F.count_if((F.col("left") != 1) | (F.col("right") != 1))).first()
    if not n or off:
        raise ValueError(f"source and target rows are not paired: {off} of {n} ids")
    return n


def paired(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """``(sample_id, x, y)`` of two tables (sample_id, v) with the same ids."""
    check_paired(src, tgt)
    return _joined(src, tgt)


def _joined(src: DataFrame, tgt: DataFrame) -> DataFrame:
    return src.select("sample_id", F.col("v").cast("array<double>").alias("x")).join(tgt.select("sample_id", F.col("v").cast("array<double>").alias("y")), "sample_id")


class Aligner:
    """Base of all maps; subclasses fit from standardised moments or rows and map standardised vectors."""

    #: Whether the subclass needs the pilots themselves.
    needs_rows = False
    #: Whether more of them than max_points are fitted as a table.
    fits_tables = False

    def __init__(self, preprocess: str = "whiten", n_components: int | float | None = None, shrinkage: float | str = 0.0, max_points: int = MAX_POINTS) -> None:
        self.preprocess, self.n_components, self.shrinkage, self.max_points = preprocess, n_components, shrinkage, max_points
        self.src: Scaler | None = None
        self.tgt: Scaler | None = None
        self.n_pilots = 0

    def fit(self, src: DataFrame, tgt: DataFrame, src_context: DataFrame | None = None, tgt_context: DataFrame | None = None) -> Aligner:
        """src, tgt: paired (sample_id, v). Contexts are unpaired rows that only the scalers learn from."""
        n, both = check_paired(src, tgt), _joined(src, tgt)
        self.src = Scaler(self.preprocess, self.n_components, self.shrinkage).fit(src if src_context is None else src_context)
        self.tgt = Scaler(self.preprocess, self.n_components, self.shrinkage).fit(tgt if tgt_context is None else tgt_context)
        if self.needs_rows:
            if n > self.max_points:
                if not self.fits_tables:
                    raise ValueError(f"more than {self.max_points} pilots")
                self._fit_table(map_vectors(map_vectors(both, self.src.apply, "x", "x"), self.tgt.apply, "y", "y"))
                return self
            rows = both.orderBy("sample_id").toArrow()
            self.n_pilots = rows.num_rows
            x, y = self.src.apply(matrix(rows.column("x"))), self.tgt.apply(matrix(rows.column("y")))
            self._fit_rows(x, y, rows.column("sample_id").to_numpy())
        else:
            scaled = map_vectors(map_vectors(both.select("x", "y"), self.src.apply, "x", "x"), self.tgt.apply, "y", "y")
            moment = moment_matrix(scaled, "x", "y")
            self.n_pilots = int(moment[0, 0])
            self._fit_moments(moment, self.src.out_dim)
        return self

    def _fit_moments(self, moment: np.ndarray, d: int) -> None:
        raise NotImplementedError

    def _fit_rows(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        raise NotImplementedError

    def _fit_table(self, both: DataFrame) -> None:
        """From standardised rows (sample_id, x, y) that stay distributed."""
        raise NotImplementedError

    def _map(self, z: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Raw source rows to raw target rows."""
        if self.src is None:
            raise RuntimeError("the map is not fitted")
        return self.tgt.invert(self._map(self.src.apply(x)))

    def transform(self, df: DataFrame, vector: str = "v") -> DataFrame:
        """df with its vectors mapped, row by row; df may be a stream."""
        if self.src is None:
            raise RuntimeError("the map is not fitted")
        return map_vectors(df, self.apply, vector, vector)

    @property
    def paired_samples_used(self) -> int:
        return self.n_pilots

    @property
    def transmitted_symbols(self) -> int:
        return min(self.src.out_dim, self.tgt.out_dim)

    @property
    def map_parameters(self) -> int:
        return self.src.out_dim * self.tgt.out_dim

    def summary(self) -> dict[str, object]:
        return {"method": type(self).__name__, "preprocess": self.preprocess, "n_components": self.n_components, "paired_used": self.paired_samples_used, "symbols": self.transmitted_symbols, "map_params": self.map_parameters}


def split_moment(moment: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """n, sums and products of x (first d columns) and y behind a moment matrix."""
    x, y = slice(1, 1 + d), slice(1 + d, None)
    return {"n": moment[0, 0], "sx": moment[0, x], "sy": moment[0, y], "xx": moment[x, x], "xy": moment[x, y], "yy": moment[y, y]}
