"""Designs that choose anchors and pilots, and the assignments that follow from them.

Random designs have two draws: ``numpy_draw`` repeats a numpy generator's stream on
the driver over row positions; the others order rows by the MD5 of seed and id,
which SQL can repeat and which needs no positions.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.functions.kernels import Kernel, by_hash
from latentspark.operators import greedy
from latentspark.operators.blocks import cut_lineage
from latentspark.operators.pairs import nearest
from latentspark.operators.spaces import mean_vectors

#: Hexadecimal digits of a hash by which the rows of a label are counted.
PREFIX = 4


def numpy_draw(n: int, size: int, seed: int) -> np.ndarray:
    """Sorted positions of a uniform draw without replacement; all if size covers the pool."""
    return np.arange(n) if size >= n else np.sort(np.random.default_rng(seed).choice(n, size, replace=False))


def at_positions(df: DataFrame, positions: Sequence[int], id_column: str = "sample_id") -> DataFrame:
    """Rows of df at positions of the id order, repeats and order kept in ``pos``."""
    spark = df.sparkSession
    ids = cut_lineage(df.select(id_column).repartitionByRange(id_column).sortWithinPartitions(id_column).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()))
    sizes = ids.groupBy("__part").agg(F.count("*").alias("n"), F.min("__in").alias("low")).orderBy("__part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["__part"], r.low, total))
        total += r.n
    if any(p < 0 or p >= total for p in positions):
        raise IndexError("position outside the table")
    bases = spark.createDataFrame(starts or [(0, 0, 0)], "__part int, low long, base long")
    ranked = ids.join(F.broadcast(bases), "__part").select(F.col(id_column), (F.col("base") + F.col("__in") - F.col("low")).alias("row"))
    wanted = spark.createDataFrame([(i, int(p)) for i, p in enumerate(positions)], "pos int, row long")
    return wanted.join(ranked, "row").drop("row").join(df, id_column)


def first_by_hash(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash with their ``place`` from 0; budgets of n are prefixes. n is a budget of pilots, not of data."""
    ordered = df.withColumn("h", by_hash(df, seed)).orderBy("h", "sample_id").limit(n)
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("h", "sample_id")) - 1).drop("h")


def aligned_subsample(agents: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The same n ids of every agent; all agents must have the same ids."""
    counts = [r["count"] for r in agents.groupBy("agent").count().collect()]
    ids = agents.select("sample_id").distinct()
    if len(set(counts)) > 1 or ids.count() != counts[0]:
        raise ValueError("agents differ in their rows")
    return agents.join(first_by_hash(ids, n, seed).select("sample_id"), "sample_id", "left_semi")


def ranked(df: DataFrame, by: str, seed: int = 0, quota: Column | None = None) -> DataFrame:
    """df with ``place``, from 1, of each row among those of its ``by`` in the order of hash and id; quota: rows beyond it are left out.

    Rows are counted by the first PREFIX digits of their hash, and ordered within those: no task holds more than a
    16^PREFIX-th of a label's rows, or that many counts, however large the label.
    """
    prefix = F.substring(by_hash(df, seed), 1, PREFIX)
    counts = df.groupBy(F.col(by).alias("_by"), prefix.alias("_prefix")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_by").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_by", "_prefix", before.alias("_before"))
    rows = df.withColumn("_at", prefix)
    met = rows.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_prefix")))
    if quota is not None:
        met = met.where(F.col("_before") < quota)
    inside = F.row_number().over(Window.partitionBy("_by", "_prefix").orderBy(by_hash(df, seed), "sample_id"))
    met = met.withColumn("place", F.col("_before") + inside)
    if quota is not None:
        met = met.where(F.col("place") <= quota)
    return met.drop("_by", "_prefix", "_before", "_at")


def biased_subsample(df: DataFrame, n: int, targets: Sequence[int], strength: float, seed: int = 0, draw: str = "quota") -> DataFrame:
    """About n rows whose labels mix a uniform draw over ``targets`` (share strength) with one over all labels.

    draw: each label's number is its rounded share ('quota'), or counted from n draws of a numpy generator ('multinomial').
    A label with too few rows gives all of them, with a warning. Rows of a label come by hash.
    """
    if draw not in ("quota", "multinomial"):
        raise ValueError(f"unknown draw {draw!r}")
    sizes = {r.label: r["count"] for r in df.where("label IS NOT NULL").groupBy("label").count().collect()}  # a row a label
    labels = sorted(sizes)
    if unknown := set(targets) - set(labels):
        raise ValueError(f"unknown labels {sorted(unknown)}")
    strength = strength if targets else 0.0
    share = np.array([strength * (x in targets) / max(1, len(targets)) + (1 - strength) / len(labels) for x in labels])
    if draw == "quota":
        counts = np.floor(n * share + 0.5).astype(int)
    else:
        counts = np.bincount(np.random.default_rng(seed).choice(len(labels), n, p=share / share.sum()), minlength=len(labels))
    quota = dict(zip(labels, counts.tolist(), strict=True))
    if short := {x: (k, sizes[x]) for x, k in quota.items() if k > sizes[x]}:
        warnings.warn(f"labels with fewer rows than asked for (asked, there): {short}", stacklevel=2)
    table = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    return ranked(df.where("label IS NOT NULL"), "label", seed, table[F.col("label")]).drop("place")


def round_robin(df: DataFrame, seed: int = 0, passes: int | None = None) -> DataFrame:
    """Order of the pool in passes over the classes, a fresh class order in each: ``(pass, class_key)`` sorts it. passes: rows of later ones are left out."""
    placed = ranked(df, "label", seed, None if passes is None else F.lit(passes))
    key = F.md5(F.concat(F.col("label").cast("string"), F.lit(":"), F.col("pass").cast("string")).cast("binary"))
    return placed.withColumn("pass", (F.col("place") - 1).cast("int")).drop("place").withColumn("class_key", key)


def classes_design(df: DataFrame, k: int, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash of k classes, the classes by hash; fewer where they have fewer."""
    chosen = df.select("label").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("label").cast("string")).cast("binary"))).orderBy("h").limit(k)
    return df.join(F.broadcast(chosen.select("label")), "label", "left_semi").orderBy(by_hash(df, seed), "sample_id").limit(n)


def ball(df: DataFrame, centre: Sequence[float], n: int) -> DataFrame:
    """The n rows nearest a centre, with their distance."""
    c = F.array(*[F.lit(float(x)) for x in centre])
    return df.withColumn("d", F.sqrt(vec.sq_dist(F.col("v"), c))).orderBy("d", "sample_id").limit(n)


def herding(df: DataFrame, k: int, kernel: Kernel, sign: int = 1, means: DataFrame | None = None) -> list[int]:
    """Greedy picks of largest mean kernel less the mean kernel with earlier picks; sign -1: of smallest (adversarial)."""
    return greedy.herding(df, k, kernel, sign, means=means).ids


def farthest_points(df: DataFrame, k: int, first: int) -> list[int]:
    """first, then greedily the row farthest from its nearest pick."""
    return greedy.farthest_points(df, k, first).ids[:k]


def voronoi(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(sample_id, anchor)``: nearest anchor of each row, the lower id on ties. anchors: (sample_id, v)."""
    return nearest(df, anchors, 1).select(F.col("src").alias("sample_id"), F.col("dst").alias("anchor"))


def medoids(df: DataFrame, by: str) -> DataFrame:
    """``(by, sample_id)``: the member nearest its group's mean."""
    centroids = mean_vectors(df, [by])
    d = vec.sq_dist(F.col("v"), F.col("centroid"))
    near = df.join(centroids, by).groupBy(by).agg(F.min(F.struct(d.alias("d"), "sample_id")).alias("near"))
    return near.select(by, F.col("near.sample_id").alias("sample_id"))


def injected_anchors(membership: DataFrame, space: DataFrame) -> DataFrame:
    """``(anchor, centroid)``: means of this space's rows over another space's clusters."""
    return mean_vectors(membership.join(space.select("sample_id", "v"), "sample_id"), ["anchor"])


def scheduled_bandwidth(n: Column, pool: Column, base: float = 3.9, power: float = 0.7) -> Column:
    return F.lit(base) * F.pow(n / pool, power)
