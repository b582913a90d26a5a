"""Neighbour graphs as edge tables, and their Laplacians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.operators.blocks import cut_lineage
from latentspark.operators.pairs import nearest


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def knn_graph(df: DataFrame, k: int, weighted: bool = False, mutual: bool = False) -> DataFrame:
    """``(src, dst, w)``, both directions of each edge.

    Weights are 1, or exp(-d^2 / 2s^2) with s the mean distance to the k-th neighbour
    (1 if that is 0). Directions are united by the larger weight; mutual edges need
    both, and average them.
    """
    near = cut_lineage(nearest(df, None, k))
    if weighted:
        s = near.where(F.col("place") == k).agg(F.avg("d")).first()[0] or 1.0
        edges = near.select("src", "dst", F.exp(-F.col("d") * F.col("d") / (2 * s * s)).alias("w"))
    else:
        edges = near.select("src", "dst", F.lit(1.0).alias("w"))
    if mutual:
        return _both_ways(edges).groupBy("src", "dst").agg(F.avg("w").alias("w"), F.count("*").alias("n")).where("n = 2").drop("n")
    return _both_ways(edges).groupBy("src", "dst").agg(F.max("w").alias("w"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, degree)`` of every node, 0 for isolated ones. nodes: (node)."""
    d = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def _with_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges, nodes)
    return edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d_src")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d_dst")), "dst")


def _over(w: Column, by: Column) -> Column:
    """w / by; 0 where weights so small that a degree is 0 leave nothing to divide by."""
    return F.when(by > 0, w / by).otherwise(0.0)


def laplacian(edges: DataFrame, nodes: DataFrame, norm: str = "symmetric") -> DataFrame:
    """Cells ``(src, dst, l)``: unnormalized, symmetric or random_walk; isolated nodes have diagonal 1 in the latter two."""
    if norm not in ("unnormalized", "symmetric", "random_walk"):
        raise ValueError(f"unknown norm {norm!r}")
    by = {"unnormalized": F.lit(1.0), "symmetric": F.sqrt(F.col("d_src") * F.col("d_dst")), "random_walk": F.col("d_src")}[norm]
    off = _with_degrees(edges, nodes).select("src", "dst", (-_over(F.col("w"), by)).alias("l"))
    diagonal = F.col("degree") if norm == "unnormalized" else F.lit(1.0)
    return off.union(degrees(edges, nodes).select(F.col("node").alias("src"), F.col("node").alias("dst"), diagonal.alias("l")))


def alpha_renormalised(edges: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """Edges with w / (d_src d_dst)^alpha."""
    return _with_degrees(edges, nodes).select("src", "dst", _over(F.col("w"), F.pow(F.col("d_src") * F.col("d_dst"), alpha)).alias("w"))
