"""Connected components of an edge table by alternating star contractions.

Every step is a min-aggregate (combined on the map side) and an equi-join that
adaptive execution may split, so a node with very many neighbours is never
gathered in one task. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import cut_lineage

#: Contraction is logarithmic; more rounds than this are an error.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node with an edge to another node; root is the smallest node reachable.

    Self-loops and repeated edges are ignored; an empty table gives an empty result.
    """
    pair = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    state = cut_lineage(pair.where("a > b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = cut_lineage(_small_star(_large_star(state)))
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components are unfinished after {MAX_ROUNDS} rounds")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
