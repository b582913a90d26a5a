"""Blocks of vectors, pairs of blocks, and moments: the all-pairs and matrix work of the engine.

A block is one row that holds up to ``BLOCK`` vectors as a matrix. A pair of
blocks is one unit of work in numpy, done for ``STRIP`` rows of the left block at a
time; it returns aggregates or a few rows for each vector, so that neither side is
broadcast or collected and no task holds more than two blocks and a strip of
results. What is shuffled falls as blocks grow, by n^2 / block.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
#: Small tables are cut into this many blocks, for as many tasks.
SPREAD = 16
LEAST = 128
#: Left rows of a pair of blocks that meet the right block at a time: 16 MB for each array of cells of the largest block.
STRIP = 256
#: Rows of either side whose cells are made at a time where only their sums are kept: 512 KB for each array of cells, which stay in a core's cache.
TILE_ROWS, TILE_COLUMNS = 64, 1024
#: Bytes of an Arrow batch, so that a worker holds a pair of blocks or few at a time.
BATCH_BYTES = 4 << 20


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises df in the cluster's shared checkpoint folder; a folder of this machine is taken only in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of constant width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pack(table: pa.Table) -> pa.Table:
    rows = table.num_rows
    return pa.table({
        "block": table.column("block")[:1], "ids": [table.column("id").to_numpy().tobytes()], "rows": [rows],
        "vectors": [matrix(table.column("v")).tobytes()], "others": [matrix(table.column("w")).tobytes()],
    })


def pack_blocks(df: DataFrame, vector: str = "v", other: str | None = None, id_column: str = "sample_id", block: int | None = None) -> DataFrame:
    """``(block, ids, rows, vectors, others)``: about ``block`` rows of df in each row; other is a second vector of each."""
    second = F.col(other).cast("array<double>") if other else F.array().cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), second.alias("w"))
    total = rows.count()
    n = max(1, -(-total // (block or min(BLOCK, max(LEAST, -(-total // SPREAD))))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return cut_lineage(rows.groupBy("block").applyInArrow(_pack, "block int, ids binary, rows long, vectors binary, others binary"))


class Block:
    """One side of a pair of blocks."""

    def __init__(self, ids: bytes, rows: int, vectors: bytes, others: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.v = np.frombuffer(vectors, np.float64).reshape(rows, -1)
        self.w = np.frombuffer(others, np.float64).reshape(rows, -1)

    def strips(self, rows: int = STRIP) -> Iterator[Block]:
        for k in range(0, len(self.ids), rows):
            part = Block.__new__(Block)
            part.ids, part.v, part.w = self.ids[k : k + rows], self.v[k : k + rows], self.w[k : k + rows]
            yield part


def for_block_pairs(left: DataFrame, right: DataFrame | None, work: Callable, schema: str) -> DataFrame:
    """work on every pair of a left and a right block; a left block is sent once to each right block.

    right None: each two blocks of left meet once, as ``work(a, b, own)``, own being true where they are the same block;
    work then goes through a's strips itself and yields the results of both sides.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    sides = ("ids", "rows", "vectors", "others")
    same = right is None
    to = (left if same else right).select(F.col("block").alias("to"), *(F.col(c).alias(f"to_{c}") for c in sides))
    last = to.agg(F.max("to")).first()[0]
    if last is None:
        return left.sparkSession.createDataFrame([], schema)
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # A number of partitions that is asked for is not coalesced, however small the blocks.
    parts = min(2 * (last + 1), 8192)
    targets = F.sequence(F.col("block") if same else F.lit(0), F.lit(last))
    if same:  # half of the pairs from either end, so that no block is sent far more often than another
        away = F.sequence(F.lit(0), F.lit((last + 1) // 2))
        half = F.filter(F.transform(away, lambda d: F.struct(((F.col("block") + d) % (last + 1)).alias("to"), d.alias("d"))), lambda x: (2 * x["d"] != last + 1) | (x["to"] > F.col("block")))
        targets = F.transform(half, lambda x: x["to"])
    each = left.withColumn("to", F.explode(targets)).withColumn("own", F.col("to") == F.col("block")).drop("block").repartition(parts, "to")
    pairs = each.join(to.repartition(parts, "to"), "to").drop("to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                whole, against = Block(*(at[c] for c in sides)), Block(*(at[f"to_{c}"] for c in sides))
                for out in work(whole, against, at["own"]) if same else (work(strip, against) for strip in whole.strips()):
                    yield pa.RecordBatch.from_pydict({c: pa.array(out[c]) for c in names})

    return pairs.mapInArrow(run, schema)


def both_sums(a: Block, b: Block, own: bool, cells: Callable[[Block, Block], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Row sums over b of each of a's rows and, unless they are one block, column sums for b's rows, by tiles of cells."""
    rows: dict[str, np.ndarray] = {}
    columns: dict[str, np.ndarray] = {}
    for j, part in enumerate(b.strips(TILE_COLUMNS)):
        right = slice(j * TILE_COLUMNS, (j + 1) * TILE_COLUMNS)
        for i, strip in enumerate(a.strips(TILE_ROWS)):
            for c, x in cells(strip, part).items():
                rows.setdefault(c, np.zeros(len(a.ids)))[i * TILE_ROWS : (i + 1) * TILE_ROWS] += x.sum(axis=1)
                if not own:
                    columns.setdefault(c, np.zeros(len(b.ids)))[right] += x.sum(axis=0)
    out, ids, counts = rows, a.ids, np.full(len(a.ids), len(b.ids))
    if not own:
        out = {c: np.concatenate([rows[c], columns[c]]) for c in rows}
        ids, counts = np.concatenate([ids, b.ids]), np.concatenate([counts, np.full(len(b.ids), len(a.ids))])
    return {"id": ids, "n": counts} | out


def column_sums(df: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """``(key, n, s)``: rows and summed vectors of each value of ``by``, a row for each task and value before they meet."""
    kind = df.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("key").type
            coded, x = batch.column("key").dictionary_encode(), matrix(batch.column("v"))
            place = coded.indices.to_numpy(zero_copy_only=False)
            s, n = np.zeros((len(coded.dictionary), x.shape[1])), np.bincount(place, minlength=len(coded.dictionary))
            np.add.at(s, place, x)
            for k, key in enumerate(coded.dictionary.to_pylist()):
                had = totals.get(key, (0, 0.0))
                totals[key] = (had[0] + int(n[k]), had[1] + s[k])
        if totals:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(totals), kind), "n": [n for n, _ in totals.values()], "s": [s for _, s in totals.values()]})

    rows = df.where(F.col(by).isNotNull()).select(F.col(by).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    parts = rows.mapInArrow(partial, f"key {kind}, n long, s array<double>")
    sums = parts.select("key", "n", F.posexplode("s").alias("dim", "x")).groupBy("key", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("s"))


def moments(df: DataFrame, *vectors: str) -> DataFrame:
    """``(i, j, s)``, i <= j: sums of products of the columns [1, vectors...] over all rows of df, 0 being the 1."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([np.ones((batch.num_rows, 1)), *(matrix(batch.column(c)) for c in vectors)], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    rows = df.select(*(F.col(c).cast("array<double>").alias(c) for c in vectors))
    return rows.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def moment_matrix(df: DataFrame, *vectors: str) -> np.ndarray:
    """moments as one symmetric matrix on the driver; its size is that of the vectors' widths, whatever the rows."""
    cells = moments(df, *vectors).toPandas()
    if not len(cells):
        raise ValueError("no rows")
    out = np.zeros((int(cells.j.max()) + 1,) * 2)
    out[cells.i, cells.j] = cells.s
    return np.triu(out) + np.triu(out, 1).T


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column("m"):
            found = np.frombuffer(part.as_py())
            total = found.copy() if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})


def made_moment(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """moment_matrix of wide rows that ``make`` builds of strips of df's: a matrix for each task, added in levels before one reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                x = make(batch.slice(at, STRIP))
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = df.mapInArrow(partial, "m binary").repartition(SPREAD).mapInArrow(_added, "m binary").repartition(1).mapInArrow(_added, "m binary")
    found = parts.collect()
    if not found:
        raise ValueError("no rows")
    flat = np.frombuffer(found[0].m)
    return flat.reshape((int(round(len(flat) ** 0.5)), -1))


def map_vectors(df: DataFrame, apply: Callable[[np.ndarray], np.ndarray], vector: str = "v", out: str = "v") -> DataFrame:
    """df with ``out`` = apply(matrix of vector), by Arrow batches; works on streams too."""
    kept = [c for c in df.columns if c not in (vector, out)]
    schema = df.select(*kept, F.col(vector).cast("array<double>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in kept}
            made = np.asarray(apply(matrix(batch.column(out))), np.float64) if batch.num_rows else np.zeros((0, 1))
            bounds = np.arange(len(made) + 1, dtype=np.int32) * (made.shape[1] if made.ndim == 2 else 1)
            columns[out] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(made.ravel()))
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in schema.names})

    return df.select(*kept, F.col(vector).cast("array<double>").alias(out)).mapInArrow(run, schema)
