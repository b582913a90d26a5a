"""Fitted maps on streams. A map works row by row and its centring doesn't depend on
the batch, so a stream gives the rows that a table would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.operators.align.base import Aligner


def map_stream(stream: DataFrame, aligner: Aligner, vector: str = "v") -> DataFrame:
    """The stream with its vectors mapped; no state."""
    return aligner.transform(stream, vector)


def drift(stream: DataFrame, time: str, mean: list[float], window: str = "5 minutes", delay: str = "10 minutes", vector: str = "v") -> DataFrame:
    """By event-time window: rows and their mean squared distance from the mean that a map was fitted on."""
    centre = F.array(*[F.lit(float(x)) for x in mean])
    d = F.aggregate(F.zip_with(vector, centre, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda acc, x: acc + x)
    return stream.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(d).alias("mean_sq_dist"))
