"""SimHash near-duplicates by exact tiled comparison of 64-bit fingerprints.

Distinct fingerprints are laid out in cells by the population counts of their
segments. Two fingerprints within ``radius`` bits have segment counts whose
differences sum to at most ``radius``, so only such cell pairs are compared; a
cell larger than ``TILE_ROWS`` is cut into several tiles. A tile is one row with an
array of fingerprints, so that what is repeated and shuffled for the comparisons is
arrays and not a row for each fingerprint. A tile meets those that follow it in
groups of at most about ``MEET_ROWS`` fingerprints; a group is compared with numpy
exclusive-or and bit counts and returns a spanning forest of its links, never all
pairs.

More segments compare fewer pairs and make more tiles. ``segments_for`` takes the
number whose estimated time is least; the estimate is one formula for all sizes.

Defined cases: a null, empty or word-less text has fingerprint 0 and links like
any other; a text of one or two words is one shingle; equal fingerprints always
link; repeated rows stay as rows of one component; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, cut_lineage, in_one_column
from latentspark.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE_ROWS = 8192
MEET_ROWS = 1 << 16
#: Numbers of a block that is compared at a time; it stays in a core's cache.
BLOCK = 1 << 17
#: Shingles whose hashes are unpacked to bits at a time.
CHUNK = 1 << 16
#: A fingerprint of over one part of so many of the rows is joined by broadcast, the rest by shuffling.
HEAVY_PARTS = 1000
#: Seconds for one comparison, for one meeting of two tiles and for one group of them, measured with numpy and Spark in local mode.
COMPARE_S, MEET_S, GROUP_S = 0.7e-9, 10e-6, 60e-6
MAX_SEGMENTS = 16
#: Estimated seconds of comparisons in a task.
TASK_S = 20
#: Tiles of cut cells that may be broadcast (some 30 bytes each), and ids of dropped documents (some 40).
BROADCAST_CELLS = 1_000_000
BROADCAST_IDS = 2_000_000


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles of a UTF-8 text (only A-Z are lower-cased)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), b"", b""]
        shingles: Iterator[bytes] = iter(words[:1])
        total = 1
    else:
        total = len(words) - SHINGLE + 1
        shingles = (b"%b %b %b" % three for three in zip(words, words[1:], words[2:], strict=False))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    while part := [digest(s, SEED) for s in itertools.islice(shingles, CHUNK)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp long)`` of every row of docs."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def tile_links(left: np.ndarray, right: np.ndarray, own: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (node, root) values, of the links of left with right and, if own, within left."""
    values = np.concatenate([left, right])
    first = 0 if own else len(left)
    label = np.arange(len(values))
    width = min(TILE_ROWS, max(1, len(values) - first))
    step = max(1, BLOCK // width)
    for start in range(first, len(values), width):
        other = values[start : start + width]
        for at in range(0, len(left), step):
            if start + width <= at:
                continue  # an earlier block within left has compared these
            near = np.bitwise_count(left[at : at + step, None] ^ other[None, :]) <= radius
            for r in np.flatnonzero(near.any(axis=1)):
                found = np.append(label[start : start + width][near[r]], label[at + r])
                if found.min() < found.max():
                    mine = np.unique(found)
                    label[np.isin(label, mine[1:])] = mine[0]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _compare_groups(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.uint64),) * 2]
            own = batch.column("own").to_pylist()
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("left", "right"))
                found.append(tile_links(left, right, own[k], radius))
            yield pa.RecordBatch.from_pydict({c: np.concatenate([x[j] for x in found]).view(np.int64) for j, c in enumerate("ab")})

    return compare


def _offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Cell offsets of total size at most radius, one of each opposite pair, without zero."""
    found = {(0,) * segments}
    for _ in range(radius):
        found |= {o[:j] + (o[j] + s,) + o[j + 1 :] for o in found for j in range(segments) for s in (-1, 1)}
    return sorted(o for o in found if o > (0,) * segments)


def _widths(segments: int) -> list[int]:
    return [64 * (j + 1) // segments - 64 * j // segments for j in range(segments)]


def _spread(segments: int, radius: int) -> tuple[float, float]:
    """For random fingerprints, the part of all pairs whose cells are compared and the number of cells of even use."""
    near, same = np.ones(1), 1.0
    for w in _widths(segments):
        p = np.array([math.comb(w, k) for k in range(w + 1)]) / 2.0**w
        apart = np.convolve(p, p[::-1])[w:] * np.r_[1.0, np.full(w, 2.0)]
        near, same = np.convolve(near, apart)[: radius + 1], same * apart[0]
    return float(near.sum()), 1 / same


def estimated_seconds(n: int, segments: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> float:
    """Core seconds of the comparisons of n random fingerprints."""
    part, cells = _spread(segments, radius)
    cells = min(cells, n)
    pairs = part * n * n / 2
    meetings = cells * (1 + len(_offsets(segments, radius))) + pairs / tile_rows**2
    return COMPARE_S * pairs + MEET_S * meetings + GROUP_S * (cells + pairs / tile_rows / MEET_ROWS)


def segments_for(n: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> int:
    return min(range(1, MAX_SEGMENTS + 1), key=lambda s: estimated_seconds(n, s, radius, tile_rows))


def near_pairs(distinct: DataFrame, n_distinct: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS, segments: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all of distinct's ``fp`` values within radius bits."""
    spark = distinct.sparkSession
    segments = segments or segments_for(n_distinct, radius, tile_rows)
    cell, base, shift, bases = F.lit(0).cast("long"), 1, 0, []
    for w in _widths(segments):
        bits = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long"))
        cell = cell + (F.bit_count(bits) + radius).cast("long") * base
        bases.append(base)
        base, shift = base * (w + 2 * radius + 1), shift + w
    laid = distinct.select("fp", cell.alias("cell"))
    # Fewer than one in tile_rows fingerprints can be a cell that is cut.
    cut = laid.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")).where("tiles > 1")
    if n_distinct // tile_rows <= BROADCAST_CELLS:
        cut = F.broadcast(cut)
    tile = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    tiles = cut_lineage(laid.join(cut, "cell", "left").groupBy("cell", tile.alias("tile")).agg(F.collect_list("fp").alias("fps"), F.count("*").alias("n")))
    sizes = tiles.select("cell", "tile", "n")
    steps = F.array(*[F.lit(sum(x * b for x, b in zip(o, bases, strict=True))).cast("long") for o in _offsets(segments, radius)], F.lit(0).cast("long"))
    ahead = sizes.select(F.col("cell").alias("of_cell"), F.col("tile").alias("of_tile"), F.explode(steps).alias("step"))
    to = (F.col("of_cell") + F.col("step") == F.col("cell")) & ((F.col("step") != 0) | (F.col("tile") > F.col("of_tile")))
    before = Window.partitionBy("of_cell", "of_tile").orderBy("cell", "tile").rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / MEET_ROWS).cast("int")
    met = cut_lineage(ahead.join(sizes, to).select("of_cell", "of_tile", "cell", "tile", group.alias("group")))
    groups = met.groupBy("of_cell", "of_tile").agg((F.max("group") + 1).alias("groups"))
    left = tiles.select(F.col("cell").alias("of_cell"), F.col("tile").alias("of_tile"), "fps").join(groups, ["of_cell", "of_tile"], "left")
    left = left.select("of_cell", "of_tile", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("group"), F.col("fps").alias("left"), F.lit(None).cast("array<long>").alias("right"))
    right = met.join(tiles.select("cell", "tile", "fps"), ["cell", "tile"]).select("of_cell", "of_tile", "group", F.lit(None).cast("array<long>").alias("left"), F.col("fps").alias("right"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(estimated_seconds(n_distinct, segments, radius, tile_rows) / TASK_S))
    key = ["of_cell", "of_tile", "group"]
    joined = left.union(right).repartition(tasks, *key).groupBy(*key)
    joined = joined.agg(F.first("left", ignorenulls=True).alias("left"), F.flatten(F.collect_list("right")).alias("right"))
    return joined.select("left", "right", (F.col("group") == 0).alias("own")).mapInArrow(_compare_groups(radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)`` of every row; kept marks rows of the smallest doc_id."""
    rows = cut_lineage(fingerprints(docs))
    groups = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    n_groups, n_rows = groups.agg(F.count("*"), F.sum("n")).first()
    linked = connected_components(near_pairs(groups.select("fp"), n_groups, radius, tile_rows), "a", "b")
    rooted = groups.join(linked, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = rooted.join(smallest, "root").select("fp", F.col("component_id").alias("moved_id"))
    named = cut_lineage(groups.join(moved, "fp", "left").select(F.col("fp").alias("of"), F.coalesce("moved_id", "first_id").alias("component_id"), "n"))
    # Fewer than HEAVY_PARTS fingerprints can each have more than that part of the rows; theirs need no shuffle.
    is_heavy = F.col("n") > (n_rows or 0) // HEAVY_PARTS + 1
    heavy, light = F.broadcast(named.where(is_heavy).drop("n")), named.where(~is_heavy).drop("n")
    of = F.col("fp") == F.col("of")
    out = rows.join(heavy, of).union(rows.join(heavy.select("of"), of, "left_anti").join(light, of))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_per_component(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component: of the smallest doc_id, and of repeated ids the row of least text.

    Texts stay where they are as long as the dropped ids can be broadcast; beyond that they are joined by shuffling.
    """
    found = cut_lineage(simhash_components(docs, radius).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count_if("kept").alias("n")))
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("dropped_id"))
    n_dropped, repeated = found.agg(F.count_if(~F.col("kept")), F.coalesce(F.max("n"), F.lit(0))).first()
    if n_dropped <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), in_one_column(docs))
    survivors = rows.join(dropped, F.col("id") == F.col("dropped_id"), "left_anti")
    if n_dropped and not found.where("doc_id IS NULL AND NOT kept").isEmpty():
        survivors = survivors.where("id IS NOT NULL")
    if repeated > 1:
        ordered = ["text", *(c for c in docs.columns if c != "text")]
        least = F.min(F.struct(*(F.col("row")[c].alias(c) for c in ordered)))
        survivors = survivors.groupBy("id").agg(least.alias("row"))
    return survivors.select(*(F.col("row")[c].alias(c) for c in docs.columns))
