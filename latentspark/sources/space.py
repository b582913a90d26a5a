"""One model's rows as an object: the handful of operations that studies chain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import selection
from latentspark.operators.scaling import Scaler
from latentspark.operators.spaces import standardised
from latentspark.sources.tables import read_space


@dataclass(frozen=True)
class LatentSpace:
    """Rows (sample_id, v, and label or others); every operation gives another space."""

    rows: DataFrame
    name: str = ""
    seed: int = 0

    @classmethod
    def read(cls, spark: SparkSession, path: str, model: str, split: str, embedding: str = "embedding", seed: int = 0) -> LatentSpace:
        return cls(read_space(spark, path, model, split, embedding).withColumnRenamed("embedding", "v"), model, seed)

    @property
    def n_points(self) -> int:
        return self.rows.count()

    @property
    def dim(self) -> int:
        """The rows' width; several widths are an error."""
        least, most = self.rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
        if least != most:
            raise ValueError(f"vectors of {least} to {most} numbers")
        return least or 0

    def select(self, positions: Sequence[int]) -> LatentSpace:
        """Rows at positions of the id order, repeats and order kept in ``pos``."""
        return replace(self, rows=selection.at_positions(self.rows, positions))

    def subsample(self, n: int, seed: int | None = None) -> LatentSpace:
        return replace(self, rows=selection.first_by_hash(self.rows, n, self.seed if seed is None else seed).drop("place"))

    def biased_subsample(self, n: int, targets: Sequence[int], strength: float, seed: int | None = None) -> LatentSpace:
        """n rows of which a share is drawn from the target labels; the whole space where n covers it."""
        if "label" not in self.rows.columns:
            raise ValueError("a space without labels can't be drawn from by label")
        if not targets or strength <= 0:
            return self.subsample(n, seed)
        if n >= self.n_points:
            return self
        return replace(self, rows=selection.biased_subsample(self.rows, n, targets, strength, self.seed if seed is None else seed, "multinomial"))

    def normalize(self, method: str = "standard") -> LatentSpace:
        """'standard', 'center', 'l2' or 'whiten'."""
        if method == "whiten":
            return replace(self, rows=Scaler("whiten").fit(self.rows).transform(self.rows))
        return replace(self, rows=standardised(self.rows, method))
