"""One door to all designs that choose pilots or anchors, by name; budgets of greedy designs share a path."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.functions.kernels import Kernel, median_sq_dist
from latentspark.operators import selection
from latentspark.operators.align.anchors import lloyd
from latentspark.operators.blocks import cut_lineage
from latentspark.operators.clusterers import NOISE, Clusterer, clustered
from latentspark.operators.spaces import mean_vectors

#: Designs whose budgets are prefixes of one order.
NESTED = ("random", "herding", "anti_herding", "fps", "round_robin", "ball")
STRATEGIES = (*NESTED, "kmeans", "stratified", "classes:k")


def parse_design(name: str) -> tuple[str, int | None]:
    """'classes:3' is ('classes', 3); other names take no number."""
    head, _, tail = name.partition(":")
    if head == "classes":
        if not tail.isdigit() or int(tail) < 1:
            raise ValueError(f"{name!r} needs a number of classes")
        return head, int(tail)
    if tail or name not in STRATEGIES:
        raise ValueError(f"unknown design {name!r}")
    return head, None


def clusters(df: DataFrame, k: int, seed: int = 0, clusterer: Clusterer | None = None) -> DataFrame:
    """df with ``cluster`` from distributed k-means (parallel starts), or from a clusterer of one's own."""
    if clusterer is not None:
        return clustered(df, clusterer, seed)
    rows = df.withColumn("__features", array_to_vector("v"))
    return KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster", maxIter=50).fit(rows).transform(rows).drop("__features")


#: Rounds of the k-means of all classes at once.
CLASS_ROUNDS = 20
STARTS = 16


def _class_clusters(rows: DataFrame, quota: dict, seed: int) -> DataFrame:
    """rows (sample_id, label, v) with ``cluster`` within its class: Lloyd's rounds for all classes together.

    Centres are as many as the quotas, a budget; each round sends rows to the nearest centre of their class and sums
    by centre on the map side. Starts are the clusters of ``STARTS`` rows a centre, the first of each class by hash.
    """
    table = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    first = selection.ranked(rows.select("label", "sample_id", "v"), "label", seed, STARTS * table[F.col("label")])
    some: dict = {}
    for r in first.orderBy("label", "place").collect():  # a budget of rows
        some.setdefault(r.label, []).append([float(x) for x in r.v])
    centres = {}
    for label, found in some.items():
        x = np.array(found)
        group = lloyd(x, quota[label], seed)
        centres |= {(label, j): x[group == k].mean(axis=0).tolist() for j, k in enumerate(np.unique(group))}
    spark = rows.sparkSession
    for _ in range(CLASS_ROUNDS):
        listed = spark.createDataFrame([(label, k, v) for (label, k), v in centres.items()], f"of {rows.schema['label'].dataType.simpleString()}, cluster int, centre array<double>")
        per_class = F.broadcast(listed.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres")))
        near = F.array_min(F.transform("centres", lambda c: F.struct(vec.sq_dist(F.col("v").cast("array<double>"), c["centre"]).alias("d"), c["cluster"].alias("cluster"))))["cluster"]
        said = rows.join(per_class, F.col("label") == F.col("of")).withColumn("cluster", near).drop("of", "centres")
        moved = {(r.label, r.cluster): list(r.centroid) for r in mean_vectors(said, ["label", "cluster"]).collect()}
        still = max((abs(a - b) for k, v in moved.items() for a, b in zip(v, centres[k], strict=True)), default=0.0) < 1e-9
        centres |= moved
        if still:
            break
    return said


def stratified(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Anchors by class: quotas as even as n allows (larger ones by hash of the class), each class clustered into as
    many groups as its quota, and each group's medoid taken. Repeats drop out, so fewer than n may come, with a warning."""
    labels = [r.label for r in df.where("label IS NOT NULL").select("label").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("label").cast("string")).cast("binary"))).orderBy("h", "label").collect()]
    share, extra = divmod(n, max(1, len(labels)))
    quota = {x: share + (i < extra) for i, x in enumerate(labels) if share + (i < extra)}
    if not quota:
        return df.select("sample_id").limit(0)
    rows = cut_lineage(df.where(F.col("label").isin(list(quota))).select("sample_id", "label", "v"))
    said = _class_clusters(rows, quota, seed) if max(quota.values()) > 1 else rows.withColumn("cluster", F.lit(0))
    means = mean_vectors(said, ["label", "cluster"])
    near = said.join(means, ["label", "cluster"]).groupBy("label", "cluster").agg(F.min(F.struct(vec.sq_dist(F.col("v"), F.col("centroid")).alias("d"), "sample_id")).alias("near"))
    chosen = cut_lineage(near.select(F.col("near.sample_id").alias("sample_id")).distinct())
    if (got := chosen.count()) < n:
        warnings.warn(f"stratified left {got} of {n} anchors: clusters shared a medoid or a class is small", stacklevel=2)
    return chosen


def support(membership: DataFrame, n_samples: int | None = None, seed: int = 0) -> DataFrame:
    """``(anchor, sample_id)`` of the rows that an anchor's mean is taken over: all members, or ``n_samples`` by hash.

    membership: (sample_id, cluster); noise makes no anchor.
    """
    rows = membership.where((F.col("cluster") != NOISE) & F.col("cluster").isNotNull())
    if n_samples is not None:
        rows = selection.ranked(rows, "cluster", seed, F.lit(n_samples))
    return rows.select(F.col("cluster").alias("anchor"), "sample_id")


def prototypes(df: DataFrame, membership: DataFrame, n_samples: int | None = None, seed: int = 0) -> DataFrame:
    """``(anchor, centroid)``: means over each anchor's support; the same membership gives the matching anchors of another space."""
    return mean_vectors(df.join(support(membership, n_samples, seed), "sample_id"), ["anchor"])


def select_pilots(df: DataFrame, n: int, strategy: str = "herding", seed: int = 0, kernel: Kernel | None = None, clusterer: Clusterer | None = None, means: DataFrame | None = None) -> DataFrame:
    """``(sample_id, place)`` of n pilots of df (sample_id, v, label); all rows where n covers the pool.

    clusterer: in place of k-means in the design of that name; rows that it leaves out are no pilots.
    means: df's ``mean_kernel`` by a fitted kernel, for herding designs that share it.
    """
    head, k = parse_design(strategy)
    if n <= 0:
        raise ValueError("a budget must be positive")
    spark = df.sparkSession
    if n >= df.count():
        return df.select("sample_id", F.lit(None).cast("int").alias("place"))
    if head in ("herding", "anti_herding"):
        fitted = (kernel or Kernel()).fitted(median_sq_dist(df))
        ids = selection.herding(df.select("sample_id", "v"), n, fitted, 1 if head == "herding" else -1, means)
        return spark.createDataFrame(list(enumerate(ids)), "place int, sample_id long").select("sample_id", "place")
    if head == "fps":
        ids = selection.farthest_points(df.select("sample_id", "v"), n, selection.first_by_hash(df, 1, seed).first().sample_id)
        return spark.createDataFrame(list(enumerate(ids)), "place int, sample_id long").select("sample_id", "place")
    if head == "kmeans":
        said = clusters(df, n, seed, clusterer).select("sample_id", "v", "cluster").where(F.col("cluster") != NOISE)
        chosen = selection.medoids(said, "cluster").select("sample_id")
    elif head == "stratified":
        chosen = stratified(df, n, seed)
    elif head == "classes":
        chosen = selection.classes_design(df, k, n, seed)
    elif head == "round_robin":
        chosen = selection.round_robin(df, seed, n).orderBy("pass", "class_key").limit(n)
        return chosen.withColumn("place", F.row_number().over(Window.orderBy("pass", "class_key")) - 1).select("sample_id", "place")  # n rows, a budget
    elif head == "ball":
        centre = selection.first_by_hash(df, 1, seed).first().v
        return selection.ball(df, centre, n).withColumn("place", F.row_number().over(Window.orderBy("d", "sample_id")) - 1).select("sample_id", "place")
    else:
        return selection.first_by_hash(df, n, seed).select("sample_id", "place")
    return chosen.select("sample_id", F.lit(None).cast("int").alias("place"))


#: What a repeat adds to a study's seed.
REPEAT = 1000


def draw_pilots(df: DataFrame, budget: int, strategy: str, repeat: int, seed: int = 0, pool_size: int | None = None, kernel: Kernel | None = None) -> DataFrame:
    """``(sample_id, place)`` of one repeat of a cell: a pool drawn anew by hash, and the design within it, both by seed + 1000 repeat.

    A design that gives one answer for a pool so varies from repeat to repeat. pool_size None, or beyond the table: the whole table.
    """
    own = seed + REPEAT * repeat
    pool = df
    if pool_size is not None:
        pool = df.join(selection.first_by_hash(df.select("sample_id"), pool_size, own).select("sample_id"), "sample_id", "left_semi")
    return select_pilots(pool, budget, strategy, own, kernel)


def select_pilot_path(df: DataFrame, budgets: Sequence[int], strategy: str = "herding", seed: int = 0, kernel: Kernel | None = None) -> DataFrame:
    """``(budget, sample_id)``: one run of a nested design cut at every budget, or a run for each of the others."""
    if strategy in NESTED:
        path = select_pilots(df, max(budgets), strategy, seed, kernel)
        if max(budgets) < df.count():
            inside = F.filter(F.array(*[F.lit(b) for b in sorted(set(budgets))]), lambda b: F.col("place") < b)
            return path.select(F.explode(inside).alias("budget"), "sample_id")
    parts = [select_pilots(df, b, strategy, seed, kernel).select(F.lit(b).alias("budget"), "sample_id") for b in sorted(set(budgets))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
