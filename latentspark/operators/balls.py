"""Exact nearest neighbours that skip pairs of blocks: blocks are balls, and the triangle inequality rules pairs out.

Rows are dealt to the nearest of a budget of centres drawn by hash, and a centre's rows to blocks of at most
``BLOCK``, so that a block is a small ball however many rows crowd around one place. A block first meets
itself and the ``FIRST`` blocks whose centres are nearest. From then on each of its rows has a distance
beyond which nothing matters, and the largest of them is the block's reach. It has to meet only blocks whose
balls come within that reach: centre distance less both radii. Which pairs those are is itself found by pairs of blocks, of centres.

Tables that have structure skip most pairs; on rows without any, where every ball touches every other, ``pairs.nearest``
does the same work in half the pairs. The rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.kernels import by_hash, sq_dists
from latentspark.operators.blocks import BATCH_BYTES, BLOCK, Block, cut_lineage, for_block_pairs, map_vectors, matrix, pack_blocks
from latentspark.operators.pairs import first_of

#: Centres: at most, and rows for each at least.
MOST_CENTRES, ROWS_A_CENTRE = 4096, 128
#: Blocks that a block meets before its reach is known, itself not counted.
FIRST = 3
#: Widens what rounding may have shortened.
SLACK = 1e-9
_SIDES = "ids binary, rows long, vectors binary, others binary"
FOUND = "src long, dst long, d double"


class Neighbours(NamedTuple):
    """rows (src, dst, d, place), and of all pairs of a left and a right block the share that never met."""

    rows: DataFrame
    skipped: float


def _packed_ball(table: pa.Table) -> pa.Table:
    x = matrix(table.column("v"))
    centre = x.mean(axis=0)
    radius = float(np.sqrt(sq_dists(x, centre[None]).max()))
    return pa.table({
        "block": table.column("block")[:1], "ids": [table.column("id").to_numpy().tobytes()], "rows": [len(x)], "vectors": [x.tobytes()], "others": [b""],
        "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [radius],
    })


def pack_balls(df: DataFrame, centres: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(block, ids, rows, vectors, others, centre, radius)`` of df (sample_id, v); block numbers are places in the order of ball and part."""
    rows = df.select(F.col("sample_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    balls = map_vectors(rows.withColumn("w", F.col("v")), lambda x: sq_dists(x, centres).argmin(axis=1)[:, None].astype(float), "w", "ball").withColumn("ball", F.col("ball")[0].cast("int"))
    balls = cut_lineage(balls)
    parts = balls.groupBy("ball").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    numbered = parts.withColumn("first", F.sum("parts").over(Window.orderBy("ball")) - F.col("parts"))  # a row a centre
    dealt = balls.join(F.broadcast(numbered), "ball").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    return cut_lineage(dealt.select("block", "id", "v").groupBy("block").applyInArrow(_packed_ball, f"block int, {_SIDES}, centre array<double>, radius double"))


def _pairs_of_balls(left: DataFrame, right: DataFrame, work: Callable[[Block, Block], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """work on pairs of blocks of balls' centres; w holds a ball's radius and reach."""
    of = lambda df, reach: df.select(F.col("block").cast("long").alias("sample_id"), F.col("centre").alias("v"), F.array("radius", reach).alias("w"))
    return for_block_pairs(pack_blocks(of(left, F.col("reach")), "v", "w"), pack_blocks(of(right, F.lit(0.0)), "v", "w"), work, schema)


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, k: int, own: bool) -> DataFrame:
    """FOUND of the rows of each pair (a, b) of blocks: a's rows with their k nearest of b's."""
    sides = ("ids", "rows", "vectors", "others")
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    met = pairs.join(left.select(F.col("block").alias("a"), *sides), "a").join(right.select(F.col("block").alias("b"), *(F.col(c).alias(f"to_{c}") for c in sides)), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                against = Block(*(at[f"to_{c}"] for c in sides))
                for strip in Block(*(at[c] for c in sides)).strips():
                    yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in first_of(strip, against, k, own).items()})

    return met.mapInArrow(run, FOUND)


def nearest_in_balls(left: DataFrame, right: DataFrame | None, k: int, centres: int | None = None, block: int = BLOCK) -> Neighbours:
    """The k right rows nearest each left row (Euclidean; the lower id on ties), and the share of block pairs skipped.

    right None: the other rows of left. Rows are those of ``pairs.nearest``.
    """
    own = right is None
    base = left if own else right
    n = base.count()
    spark = left.sparkSession
    if n == 0 or left.isEmpty():
        return Neighbours(spark.createDataFrame([], f"{FOUND}, place int"), 0.0)
    wanted = centres or max(1, min(MOST_CENTRES, n // ROWS_A_CENTRE))
    drawn = base.select("sample_id", F.col("v").cast("array<double>").alias("v")).orderBy(by_hash(base, 7), "sample_id").limit(wanted)
    points = np.array([r.v for r in drawn.collect()])  # a budget of centres
    b = pack_balls(base, points, block)
    a = b if own else pack_balls(left, points, block)
    n_a, n_b = a.count(), b.count()

    def near(x: Block, y: Block) -> dict[str, np.ndarray]:
        d = np.sqrt(sq_dists(x.v, y.v))
        keep = min(FIRST + 1, d.shape[1])
        places = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        return {"a": np.repeat(x.ids, keep), "b": y.ids[places.ravel()], "apart": np.take_along_axis(d, places, 1).ravel()}

    close = _pairs_of_balls(a.withColumn("reach", F.lit(0.0)), b, near, "a long, b long, apart double")
    place = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    first = cut_lineage(close.withColumn("place", place).where(F.col("place") <= FIRST + 1).select("a", "b"))
    found = cut_lineage(_meet(first, a, b, k, own))
    # The k-th distance of each row so far; none where fewer have been met.
    kth = found.groupBy("src").agg(F.when(F.count("*") >= k, F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1))).otherwise(float("inf")).alias("kth"))
    of_block = a.select("block", "ids").mapInArrow(_ids_of_blocks, "block int, src long")
    reach = of_block.join(kth, "src", "left").groupBy("block").agg(F.max(F.coalesce("kth", F.lit(float("inf")))).alias("reach"))

    def within(x: Block, y: Block) -> dict[str, np.ndarray]:
        gap = np.sqrt(sq_dists(x.v, y.v)) - x.w[:, :1] - y.w[:, 0]
        i, j = np.nonzero(gap <= x.w[:, 1:2] * (1 + SLACK) + SLACK)
        return {"a": x.ids[i], "b": y.ids[j]}

    reached = _pairs_of_balls(a.join(reach, "block"), b, within, "a long, b long")
    second = cut_lineage(reached.join(first, ["a", "b"], "left_anti"))
    n_met = first.count() + second.count()
    every = found.union(_meet(second, a, b, k, own))
    place = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return Neighbours(every.withColumn("place", place).where(F.col("place") <= k), 1.0 - n_met / (n_a * n_b))


def _ids_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            src = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(src), block, np.int32), "src": src})
