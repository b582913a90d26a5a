"""All-pairs operators in blocks: Gram cells, mean embeddings, ranks, neighbours, kernel alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.functions.kernels import Kernel, sq_dists
from latentspark.operators.blocks import TILE_COLUMNS, TILE_ROWS, Block, both_sums, cut_lineage, for_block_pairs, pack_blocks

#: Columns of a row whose least one stands for them where its nearest are looked for.
GROUP = 64
#: Rows that meet a block at a time where only their nearest are kept.
NEAR_ROWS = 64


def gram(left: DataFrame, right: DataFrame | None, kernel: Kernel) -> DataFrame:
    """``(i, j, k)`` of every pair; the relation is as large as its two sides multiplied. right None: left with itself, i <= j."""

    def work(a: Block, b: Block) -> dict[str, np.ndarray]:
        return {"i": np.repeat(a.ids, len(b.ids)), "j": np.tile(b.ids, len(a.ids)), "k": kernel.block(a.v, b.v).ravel()}

    def half(a: Block, b: Block, own: bool) -> Iterator[dict[str, np.ndarray]]:
        for strip in a.strips():
            out = work(strip, b)
            i, j = np.minimum(out["i"], out["j"]), np.maximum(out["i"], out["j"])
            some = out["i"] <= out["j"] if own else np.ones(len(i), bool)
            yield {"i": i[some], "j": j[some], "k": out["k"][some]}

    schema = "i long, j long, k double"
    return for_block_pairs(pack_blocks(left), None, half, schema) if right is None else for_block_pairs(pack_blocks(left), pack_blocks(right), work, schema)


def centred_gram(df: DataFrame, kernel: Kernel) -> DataFrame:
    """``(i, j, k)``, i <= j: Gram cells less the means of their rows and columns. A row's mean lies in its block, so that no cell is shuffled."""
    means = cut_lineage(mean_kernel(df, None, kernel))
    grand = means.agg(F.avg("mu")).first()[0]
    rows = df.select("sample_id", "v").join(means.select("sample_id", F.array("mu").alias("mean")), "sample_id")

    def half(a: Block, b: Block, own: bool) -> Iterator[dict[str, np.ndarray]]:
        for strip in a.strips():
            i, j = np.repeat(strip.ids, len(b.ids)), np.tile(b.ids, len(strip.ids))
            k = (kernel.block(strip.v, b.v) - strip.w - b.w.T + grand).ravel()
            some = i <= j if own else np.ones(len(i), bool)
            yield {"i": np.minimum(i, j)[some], "j": np.maximum(i, j)[some], "k": k[some]}

    return for_block_pairs(pack_blocks(rows, "v", "mean"), None, half, "i long, j long, k double")


def mean_kernel(left: DataFrame, right: DataFrame | None, kernel: Kernel) -> DataFrame:
    """``(sample_id, mu)``: mean kernel of each left row with all right rows (None: all left rows)."""

    def work(a: Block, b: Block) -> dict[str, np.ndarray]:
        return {"id": a.ids, "total": kernel.block(a.v, b.v).sum(axis=1), "n": np.full(len(a.ids), len(b.ids))}

    def both(a: Block, b: Block, own: bool) -> Iterator[dict[str, np.ndarray]]:
        cells = np.empty(TILE_ROWS * TILE_COLUMNS)
        yield both_sums(a, b, own, lambda x, y: {"total": kernel.block(x.v, y.v, cells[: len(x.ids) * len(y.ids)].reshape(len(x.ids), -1))})

    schema = "id long, total double, n long"
    parts = for_block_pairs(pack_blocks(left), None, both, schema) if right is None else for_block_pairs(pack_blocks(left), pack_blocks(right), work, schema)
    return parts.groupBy(F.col("id").alias("sample_id")).agg((F.sum("total") / F.sum("n")).alias("mu"))


def mmd2(pool: DataFrame, subset: DataFrame, kernel: Kernel) -> DataFrame:
    """One row ``mmd2``: squared mean discrepancy of subset and pool."""
    parts = [mean_kernel(a, b, kernel).agg(F.avg("mu").alias("m")).select((F.col("m") * sign).alias("m")) for a, b, sign in ((pool, None, 1), (subset, pool, -2), (subset, None, 1))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.sum("m").alias("mmd2"))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def paired_ranks(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """``(sample_id, rank)``: 1 + the targets more similar (cosine) to a prediction than its own.

    predicted: (sample_id, v); targets: (sample_id, v). Ties favour the own target.
    """
    both = predicted.select("sample_id", "v").join(targets.select("sample_id", F.col("v").alias("own")), "sample_id")

    def work(a: Block, b: Block) -> dict[str, np.ndarray]:
        p = _units(a.v)
        own = np.einsum("nd,nd->n", p, _units(a.w))
        # The own target is no rival, even if rounding in the product puts it above itself.
        ahead = (p @ _units(b.v).T > own[:, None]) & (a.ids[:, None] != b.ids[None])
        return {"sample_id": a.ids, "ahead": ahead.sum(axis=1)}

    parts = for_block_pairs(pack_blocks(both, "v", "own"), pack_blocks(targets), work, "sample_id long, ahead long")
    return parts.groupBy("sample_id").agg((F.sum("ahead") + 1).alias("rank"))


def _bound(d: np.ndarray, k: int) -> np.ndarray:
    """Of each row a number that its k smallest don't exceed and few others stay within: the k-th smallest of the least of groups of columns."""
    groups = d.shape[1] // GROUP
    if groups <= k:
        last = min(k, d.shape[1]) - 1
        return np.partition(d, last, axis=1)[:, last]
    least = d[:, : groups * GROUP].reshape(len(d), GROUP, groups).min(axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _first(d: np.ndarray, src: np.ndarray, dst: np.ndarray, k: int, squared: bool = False) -> dict[str, np.ndarray]:
    """The k columns nearest each row, by distance (d, or its root) and id; infinite distances are no neighbours."""
    # All that are as near as a bound of the k-th, then the first k of each row. Squares a rounding apart may have one root.
    limit = _bound(d, k)
    flat = np.flatnonzero(d <= (limit * (1 + 4 * np.finfo(float).eps) if squared else limit)[:, None])
    rows, columns = np.divmod(flat, d.shape[1])
    near = np.sqrt(d[rows, columns]) if squared else d[rows, columns]
    some = np.isfinite(near)
    rows, columns, near = rows[some], columns[some], near[some]
    order = np.lexsort((dst[columns], near, rows))
    rows, columns, near = rows[order], columns[order], near[order]
    some = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return {"src": src[rows[some]], "dst": dst[columns[some]], "d": near[some]}


def first_of(a: Block, b: Block, k: int, own: bool = False) -> dict[str, np.ndarray]:
    """The k rows of b nearest each row of a, a few rows at a time, so that their cells stay in a core's cache; own: a row is not its own neighbour."""
    parts = []
    for at in range(0, len(a.ids), NEAR_ROWS):
        ids = a.ids[at : at + NEAR_ROWS]
        d = sq_dists(a.v[at : at + NEAR_ROWS], b.v)
        if own:
            d[ids[:, None] == b.ids[None]] = np.inf
        parts.append(_first(d, ids, b.ids, k, squared=True))
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _best(near: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k nearest of each src among found ones, with their place from 0."""
    near = {c: near[c] for c in ("src", "dst", "d")}
    order = np.lexsort((near["dst"], near["d"], near["src"]))
    near = {c: x[order] for c, x in near.items()}
    near["place"] = np.arange(len(order)) - np.searchsorted(near["src"], near["src"])
    some = near["place"] < k
    return {c: x[some] for c, x in near.items()}


def nearest(left: DataFrame, right: DataFrame | None, k: int) -> DataFrame:
    """``(src, dst, d, place)``: the k right rows nearest each left row (Euclidean; the lower id on ties).

    right None: the other rows of left, a row not being its own neighbour.
    """

    def work(a: Block, b: Block) -> dict[str, np.ndarray]:
        return first_of(a, b, k)

    def both(a: Block, b: Block, own: bool) -> Iterator[dict[str, np.ndarray]]:
        kept: dict[str, np.ndarray] | None = None
        # Of b's rows the k-th distance so far, by place; only what is as near is looked at further.
        most, place = np.full(len(b.ids), np.inf), np.argsort(b.ids)
        for strip in a.strips():
            d = sq_dists(strip.v, b.v)
            np.sqrt(d, out=d)
            d[strip.ids[:, None] == b.ids[None]] = np.inf
            yield _first(d, strip.ids, b.ids, k)
            if not own:
                if kept is None or not np.isfinite(most).all():
                    more = _first(np.ascontiguousarray(d.T), b.ids, strip.ids, k)
                else:
                    rows, columns = np.nonzero(d <= most[None])
                    more = {"src": b.ids[columns], "dst": strip.ids[rows], "d": d[rows, columns]}
                kept = _best(more if kept is None else {c: np.concatenate([kept[c], more[c]]) for c in ("src", "dst", "d")}, k)
                last = np.flatnonzero(kept["place"] == k - 1)
                most[place[np.searchsorted(b.ids, kept["src"][last], sorter=place)]] = kept["d"][last]
        if kept is not None:
            yield {c: kept[c] for c in ("src", "dst", "d")}

    schema = "src long, dst long, d double"
    parts = for_block_pairs(pack_blocks(left), None, both, schema) if right is None else for_block_pairs(pack_blocks(left), pack_blocks(right), work, schema)
    place = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return parts.withColumn("place", place).where(F.col("place") <= k)


def hsic_parts(pairs: DataFrame, kernel_v: Kernel, kernel_w: Kernel) -> tuple[float, float, float, int]:
    """(<K,L>, <K,K>, <L,L>) of the double-centred kernels of pairs' v and w, and the row count.

    pairs: (sample_id, v, w). Row sums and products come from block pairs; centring is done on their totals.
    """
    packed = pack_blocks(pairs, "v", "w")

    def cells(a: Block, b: Block) -> dict[str, np.ndarray]:
        k, m = kernel_v.block(a.v, b.v), kernel_w.block(a.w, b.w)
        return {"k": k, "m": m, "km": k * m, "kk": k * k, "mm": m * m}

    def work(a: Block, b: Block, own: bool) -> Iterator[dict[str, np.ndarray]]:
        yield both_sums(a, b, own, cells)

    rows = for_block_pairs(packed, None, work, "id long, k double, m double, km double, kk double, mm double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("k", "m", "km", "kk", "mm")))
    s = rows.agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("k", "m", "km", "kk", "mm")),
        F.sum(F.col("k") * F.col("m")).alias("k_m"), F.sum(F.col("k") * F.col("k")).alias("k_k"), F.sum(F.col("m") * F.col("m")).alias("m_m"),
    ).first()
    n = s.n
    if n < 2:
        return 0.0, 0.0, 0.0, n

    def centred(inner: float, rows_product: float, a: float, b: float) -> float:
        return inner - 2 * rows_product / n + a * b / n**2

    return centred(s.km, s.k_m, s.k, s.m), centred(s.kk, s.k_k, s.k, s.k), centred(s.mm, s.m_m, s.m, s.m), n


def cka(pairs: DataFrame, kernel_v: Kernel, kernel_w: Kernel) -> tuple[float, float]:
    """(HSIC, CKA) of pairs' v and w; 0 with fewer than two rows or without spread."""
    kl, kk, ll, n = hsic_parts(pairs, kernel_v, kernel_w)
    spread = kk * ll
    return (kl / (n - 1) ** 2 if n > 1 else 0.0), (kl / np.sqrt(spread) if spread > 0 else 0.0)
