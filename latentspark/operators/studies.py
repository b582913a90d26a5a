"""Steps of the studies over their record tables: curves, peaks, gates, resumes and tables for figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.operators.records import missing_cells


def curve_at_best(rows: DataFrame, axis: str, metric: str, *ties: str) -> DataFrame:
    """The rows that share the axis value of the row of the largest metric."""
    best = rows.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), *ties).limit(1)
    return rows.join(F.broadcast(best.select(F.col(axis).alias("__best"))), F.col(axis).eqNullSafe(F.col("__best"))).drop("__best")  # one row


def at_symbols(rows: DataFrame, symbols: int | None) -> DataFrame:
    """Rows of a rate; None asks for the uncompressed ones, whose symbols are null."""
    return rows.where(F.col("symbols").eqNullSafe(F.lit(symbols).cast("long")))


def gains(rows: DataFrame, by: Sequence[str], baseline: str, metric: str) -> DataFrame:
    """Best of the other methods, the baseline's best, and the difference."""
    ours = F.max(F.when(F.col("method") != baseline, F.col(metric)))
    base = F.max(F.when(F.col("method") == baseline, F.col(metric)))
    return rows.groupBy(*by).agg(ours.alias("best"), base.alias("baseline"), (ours - base).alias("gain"))


def peaks(rows: DataFrame, variant: str, axis: str, metrics: Sequence[str]) -> DataFrame:
    """For each variant each metric's own maximum and its value at the largest axis value."""
    parts = []
    for m in metrics:
        parts += [F.max(m).alias(f"{m}_peak"), F.max_by(m, axis).alias(f"{m}_last")]
    return rows.groupBy(variant).agg(*parts)


def largest_difference(first: DataFrame, second: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row: the shared keys and the largest absolute difference of each metric."""
    right = second.select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))
    return first.join(right, list(keys)).agg(F.count("*").alias("n"), *(F.max(F.abs(F.col(m) - F.col(f"__{m}"))).alias(m) for m in metrics))


def compression(rows: DataFrame, by: Sequence[str], metric: str, whole: str = "truncate") -> DataFrame:
    """One level: mean, deviation and the mean symbols as a whole number, truncated or rounded half to even."""
    mean = F.avg("symbols")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean.cast("long").alias("symbols") if whole == "truncate" else F.bround(mean, 0).cast("long").alias("symbols"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def seed_average(rows: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Means over seeds with the least symbols delivered; null metrics are skipped."""
    return rows.groupBy(*by).agg(F.min("symbols").alias("symbols"), F.avg(metric).alias("mean"))


def pending(cells: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that are not done; a null chart or rate is a value."""
    return missing_cells(cells, done, keys)


def incomplete(records: DataFrame, axes: Sequence[str], by: str) -> DataFrame:
    """Of each ``by`` the number of cells of the grid of axes that it lacks, where there are any."""
    grid = records.select(axes[0]).distinct()
    for a in axes[1:]:
        grid = grid.crossJoin(records.select(a).distinct())  # the axes of a study, a few values each
    grid = records.select(by).distinct().crossJoin(grid)
    return missing_cells(grid, records, [by, *axes]).groupBy(by).agg(F.count("*").alias("missing"))


def require_complete(records: DataFrame, axes: Sequence[str], by: str, decoder: str | None = None) -> DataFrame:
    """records, if no ``by`` lacks a cell of the grid of axes and all come of one decoder; an error otherwise."""
    if lacking := incomplete(records, axes, by).limit(5).collect():
        raise ValueError(f"incomplete: {[tuple(r) for r in lacking]}")
    if decoder is not None and len(found := records.select(decoder).distinct().limit(3).collect()) > 1:
        raise ValueError(f"records of several decoders: {[r[0] for r in found]}")
    return records


def uneven(records: DataFrame, by: Sequence[str], within: str) -> DataFrame:
    """How many groups have each count of distinct ``within`` values; more than one row means uneven coverage."""
    return records.groupBy(*by).agg(F.countDistinct(within).alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def off_by(stored: DataFrame, refit: DataFrame, keys: Sequence[str], metric: str, tolerance: float) -> DataFrame:
    """Refits that differ from what is stored by more than the tolerance."""
    right = refit.select(*keys, F.col(metric).alias("refit"))
    return stored.join(right, list(keys)).where(F.abs(F.col(metric) - F.col("refit")) > tolerance)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with where each is first seen, by which figures list them."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen"))


def in_listed_order(rows: DataFrame, column: str, listed: Sequence[str]) -> Column:
    """Sort key: the place in the list, unknown values last."""
    place = F.array_position(F.array(*[F.lit(x) for x in listed]), F.col(column))
    return F.when(place == 0, len(listed) + 1).otherwise(place)


def figure_rows(rows: DataFrame, series: Sequence[str], axis: str, metric: str, thin: float | None = None) -> DataFrame:
    """What a line figure draws: mean by series and axis value with its place; thin drops marks nearer than that ratio to the one before."""
    means = rows.where(F.col(metric).isNotNull()).groupBy(*series, axis).agg(F.avg(metric).alias("mean"))
    line = Window.partitionBy(*series).orderBy(axis)
    out = means.withColumn("place", F.row_number().over(line))
    if thin is not None:
        out = out.withColumn("marked", F.coalesce(F.col(axis) >= thin * F.lag(axis).over(line), F.lit(True)))
    return out


def usable_ranks(widths: DataFrame, agent: str, width: str) -> DataFrame:
    """``(target, max_rank, n_pairs)``: the largest rank that every other agent can send to a target.

    It is the least of the target's width and of the narrowest other one, so two widths and a count stand for all pairs.
    """
    ends = widths.agg(F.min(width).alias("least"), F.count("*").alias("n"))
    at = widths.crossJoin(ends).agg(F.min("least").alias("least"), F.max("n").alias("n"), F.count_if(F.col(width) == F.col("least")).alias("times"), F.min(F.when(F.col(width) > F.col("least"), F.col(width))).alias("next"))
    narrow = at.select("n", "least", F.when(F.col("times") > 1, F.col("least")).otherwise(F.col("next")).alias("next"))  # one row
    own = F.col(width)
    other = F.when(own == F.col("least"), F.col("next")).otherwise(F.col("least"))
    met = widths.crossJoin(narrow).where("n > 1")
    return met.select(F.col(agent).alias("target"), F.least(own, other).cast("long").alias("max_rank"), (F.col("n") - 1).alias("n_pairs"))
