"""Greedy designs by speculation and proof: many exact picks in one pass over a pool.

The driver holds a bounded set of candidates and picks among them as if there were no other
rows. A pass then lets every row of the pool follow that path: with its kernel sums (or nearest distances) to
each prefix of the picks it knows what its own score would have been at each step, and whether it would have been picked
instead. The picks before the earliest such step of any row are proved. Each task hands over the
rows that stand in the way, the best of its earliest step first; they become candidates, and the
path is run again from the last proved pick. So every pass proves one pick at least, most prove many, and the
picks are those of one pass a pick, whatever the number of candidates.

A herding score is mu - s / t, s being the kernel sum to t picks; adversarial herding turns its sign. A
farthest point's score is its squared distance to the nearest pick.

Nothing is kept between passes but the picks and the candidates, both budgets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.functions.kernels import Kernel, sq_dists
from latentspark.operators.blocks import cut_lineage, matrix
from latentspark.operators.pairs import mean_kernel

#: Numbers of the candidates that a pass may hand over, 8 MB on the driver, which holds at most KEPT times as many.
CANDIDATE_NUMBERS, KEPT = 1 << 20, 8
#: Scores within this much of each other are equal, and the lower id is picked.
TIE = 1e-12
#: Rows of a task that follow a path at a time.
STRIP = 512
FOUND = "sample_id long, v array<double>, mu double, step int"


@dataclass
class Picked:
    """Ids in the order of their picks, and the number of passes that it took."""

    ids: list[int] = field(default_factory=list)
    passes: int = 0


class _Herding:
    """Scores by mean kernels (sign 1: the largest first; -1: the smallest)."""

    def __init__(self, kernel: Kernel, sign: int) -> None:
        self.kernel, self.sign = kernel, sign

    def along(self, x: np.ndarray, mu: np.ndarray, picks: np.ndarray) -> np.ndarray:
        """Scores of rows before each of the picks and after the last."""
        before = np.zeros((len(x), len(picks) + 1))
        if len(picks):
            np.cumsum(self.kernel.block(x, picks), axis=1, out=before[:, 1:])
        return self.sign * (mu[:, None] - before / np.maximum(np.arange(len(picks) + 1), 1))

    def start(self, x: np.ndarray, picks: np.ndarray) -> np.ndarray:
        return self.kernel.block(x, picks).cumsum(axis=1)[:, -1] if len(picks) else np.zeros(len(x))

    def more(self, s: np.ndarray, x: np.ndarray, pick: np.ndarray) -> np.ndarray:
        return s + self.kernel.block(x, pick[None])[:, 0]

    def score(self, mu: np.ndarray, s: np.ndarray, t: int) -> np.ndarray:
        return self.sign * (mu - s / max(t, 1))


class _Farthest:
    """Scores by squared distances to the nearest pick; before the first all are equal."""

    def along(self, x: np.ndarray, mu: np.ndarray, picks: np.ndarray) -> np.ndarray:
        near = np.minimum.accumulate(sq_dists(x, picks), axis=1)
        return np.concatenate([np.full((len(x), 1), -np.inf), near], axis=1)

    def start(self, x: np.ndarray, picks: np.ndarray) -> np.ndarray:
        return sq_dists(x, picks).min(axis=1)

    def more(self, s: np.ndarray, x: np.ndarray, pick: np.ndarray) -> np.ndarray:
        return np.minimum(s, sq_dists(x, pick[None])[:, 0])

    def score(self, mu: np.ndarray, s: np.ndarray, t: int) -> np.ndarray:
        return s


def _slack(score: np.ndarray | float) -> np.ndarray | float:
    return TIE * np.maximum(1.0, np.abs(score))


def _best(ids: np.ndarray, scores: np.ndarray) -> int:
    """Place of the highest score, the lowest id among equal ones."""
    top = scores.max()
    near = np.flatnonzero(scores >= top - _slack(top))
    return int(near[ids[near].argmin()])


def _speculated(rule, ids: np.ndarray, x: np.ndarray, mu: np.ndarray, picks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the next picks among candidates, up to k picks in all, and their scores."""
    s, free, places, scores = rule.start(x, picks), np.ones(len(ids), bool), [], []
    for t in range(len(picks), k):
        if not free.any():
            break
        open_ = np.flatnonzero(free)
        now = rule.score(mu[open_], s[open_], t)
        at = open_[_best(ids[open_], now)]
        free[at] = False
        places.append(at)
        scores.append(float(now[np.searchsorted(open_, at)]))
        s = rule.more(s, x, x[at])
    return np.array(places, int), np.array(scores)


def _followed(rule, picks: np.ndarray, pick_ids: np.ndarray, scores: np.ndarray, proved: int, known: np.ndarray, last: bool, most: int):
    """A task of a pass: rows that would have been picked instead, by the step at which they would have been.

    scores: of the picks from ``proved`` on; last: whether a row is wanted after the last pick.
    """

    def stopped(ids: np.ndarray, x: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first step at which each row stands in the way (past the end: never), and its score there."""
        own = rule.along(x, mu, picks)[:, proved:]
        told, slack = own[:, : len(scores)] - scores, _slack(scores)
        ahead = (told > slack) | ((np.abs(told) <= slack) & (ids[:, None] < pick_ids[None, proved:]))
        ahead = np.concatenate([ahead, np.full((len(ids), 1), last)], axis=1)
        step = np.where(ahead.any(axis=1), ahead.argmax(axis=1), len(scores) + 1)
        return step, own[np.arange(len(ids)), np.minimum(step, len(scores))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        for batch in batches:
            ids = batch.column("sample_id").to_numpy(zero_copy_only=False)
            free = ~np.isin(ids, known)
            x, mu, ids = matrix(batch.column("v"))[free], batch.column("mu").to_numpy(zero_copy_only=False)[free], ids[free]
            for at in range(0, len(ids), STRIP):
                part = slice(at, at + STRIP)
                step, score = stopped(ids[part], x[part], mu[part])
                on = step <= len(scores)
                new = [ids[part][on], x[part][on], mu[part][on], step[on], score[on]]
                pool = new if pool is None else [np.concatenate(c) for c in zip(pool, new, strict=True)]
                order = np.lexsort((pool[0], -pool[4], pool[3]))
                if len(order):
                    first = np.flatnonzero(pool[3] == pool[3].min())
                    best = first[_best(pool[0][first], pool[4][first])]
                    order = np.concatenate([[best], order[order != best][: most - 1]])
                pool = [c[order] for c in pool]
        if pool is not None and len(pool[0]):
            ids, x, mu, step, _ = pool
            yield pa.RecordBatch.from_pydict({"sample_id": ids, "v": pa.array(list(x), pa.list_(pa.float64())), "mu": mu, "step": step.astype(np.int32)})

    return run


def _greedy(rows: DataFrame, k: int, rule, width: int, first: list[tuple[int, np.ndarray]], candidates: int | None) -> Picked:
    """k picks from checkpointed rows (sample_id, v, mu)."""
    out = Picked([i for i, _ in first])
    picks = np.array([v for _, v in first]).reshape(len(first), width)
    budget = candidates or max(64, CANDIDATE_NUMBERS // width)
    most = max(2, -(-budget // max(1, rows.rdd.getNumPartitions())))
    ids, x, mu = np.zeros(0, np.int64), np.zeros((0, width)), np.zeros(0)
    while len(out.ids) < k:
        places, scores = _speculated(rule, ids, x, mu, picks, k)
        path = np.concatenate([picks, x[places]])
        path_ids = np.concatenate([np.array(out.ids, np.int64), ids[places]])
        wanted = len(path) < k
        known = np.concatenate([np.array(out.ids, np.int64), ids])
        found = rows.mapInArrow(_followed(rule, path, path_ids, scores, len(picks), known, wanted, most), FOUND).toArrow()
        out.passes += 1
        steps = found.column("step").to_numpy()
        proved = min(int(steps.min()), len(places)) if len(steps) else len(places)
        out.ids += [int(i) for i in ids[places[:proved]]]
        picks = path[: len(picks) + proved]
        if not len(steps) and wanted:
            break  # no row is left
        left = np.ones(len(ids), bool)
        left[places[:proved]] = False
        if left.sum() > (KEPT - 1) * budget:  # those that are worst now go, and can be found again
            now = np.where(left, rule.score(mu, rule.start(x, picks), len(picks)), -np.inf)
            left &= now >= np.partition(now, -(KEPT - 1) * budget)[-(KEPT - 1) * budget]
        ids, x, mu = ids[left], x[left], mu[left]
        if len(steps):
            ids = np.concatenate([ids, found.column("sample_id").to_numpy()])
            x, mu = np.concatenate([x, matrix(found.column("v"))]), np.concatenate([mu, found.column("mu").to_numpy()])
    return out


def herding(df: DataFrame, k: int, kernel: Kernel, sign: int = 1, candidates: int | None = None, means: DataFrame | None = None) -> Picked:
    """Greedy picks of largest mean kernel less the mean kernel with earlier picks; sign -1: of smallest (adversarial).

    candidates: rows that a pass may bring to the driver, by default as many as CANDIDATE_NUMBERS hold. means: df's
    ``mean_kernel``, which several designs of one pool may share, as it meets all pairs.
    """
    rows = df.join(mean_kernel(df, None, kernel) if means is None else means, "sample_id").select(F.col("sample_id").cast("long").alias("sample_id"), F.col("v").cast("array<double>").alias("v"), "mu")
    rows = cut_lineage(rows)
    first = rows.select(F.size("v")).first()
    if first is None:
        return Picked()
    return _greedy(rows, k, _Herding(kernel, sign), first[0], [], candidates)


def farthest_points(df: DataFrame, k: int, first: int, candidates: int | None = None) -> Picked:
    """first, then greedily the row farthest from its nearest pick."""
    rows = cut_lineage(df.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("v").cast("array<double>").alias("v"), F.lit(0.0).alias("mu")))
    start = rows.where(F.col("sample_id") == first).first()
    if start is None:
        raise ValueError(f"no row {first}")
    return _greedy(rows, k, _Farthest(), len(start.v), [(first, np.array(start.v))], candidates)
