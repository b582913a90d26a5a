"""Assignment of two tables' rows, one to one, at the largest sum of scores: an auction over score blocks.

Scores are computed block by block and never kept: every left row holds a list of the ``LISTED`` right rows of
highest value (score less price) and, as a bound on all others, the value of the next. Prices only rise,
so a list is exact for as long as its best value is above that bound; after that it is made again at the prices of the day.

A round deals left rows, with their lists and the prices of what they list, to groups of at most ``GROUP``. A
group runs its own auction: a row without a partner bids for its best one, by the margin over its second best and a step, and the row
that it outbids bids again. Then the highest bid for each right row counts over all groups; a
row outbid from elsewhere is in another group of the next round. Bids at prices of the past are lower and simply lose, which is why
groups need not wait for each other. Steps fall from phase to phase, each phase starting without partners
at the prices of the one before.

At the end no row would gain more than the last step by another partner: the sum of scores is within rows times that
step of the sum of prices and profits, which is a bound on every assignment. Both are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentspark.operators.blocks import Block, cut_lineage, for_block_pairs, pack_blocks

#: Partners that a left row lists, and left rows that bid together in one task.
LISTED, GROUP = 48, 4096
#: Lists double when some have run out, up to this length.
MOST_LISTED = 2048
#: Steps, as shares of the scores' range: the first, what the next is divided by, and the last.
FIRST_STEP, FALL, LAST_STEP = 1 / 8, 32, 1e-10
MAX_ROUNDS = 10_000
Scores = Callable[[np.ndarray, np.ndarray], np.ndarray]
LISTS = "person long, partners array<long>, scores array<double>, bound double"
BIDS = "person long, partner long, price double, stale boolean, phase int"


def _lists(left: DataFrame, right: DataFrame, prices: DataFrame | None, scores: Scores, listed: int) -> DataFrame:
    """LISTS of left rows (sample_id, v) at the prices (partner, price) of right rows."""
    priced = right.select("sample_id", "v", F.array(F.lit(0.0)).alias("w"))
    if prices is not None:
        priced = right.join(prices.select(F.col("partner").alias("sample_id"), "price"), "sample_id", "left").select("sample_id", "v", F.array(F.coalesce("price", F.lit(0.0))).alias("w"))

    def work(a: Block, b: Block) -> dict[str, np.ndarray]:
        s = scores(a.v, b.v)
        value = s - b.w[:, 0]
        keep = min(listed + 1, value.shape[1])
        places = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
        rows = np.repeat(np.arange(len(a.ids)), keep)
        places = places.ravel()
        return {"person": a.ids[rows], "partner": b.ids[places], "score": s[rows, places], "value": value[rows, places]}

    found = for_block_pairs(pack_blocks(left), pack_blocks(priced, "v", "w"), work, "person long, partner long, score double, value double")
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("value"), "partner"))
    first = found.withColumn("place", place).where(F.col("place") <= listed + 1)
    inside = F.filter(F.array_sort(F.collect_list(F.struct("place", "partner", "score"))), lambda x: x["place"] <= listed)
    made = first.groupBy("person").agg(inside.alias("rows"), F.max(F.when(F.col("place") > listed, F.col("value"))).alias("bound"))
    return cut_lineage(made.select("person", F.col("rows.partner").alias("partners"), F.col("rows.score").alias("scores"), F.coalesce("bound", F.lit(float("-inf"))).alias("bound")))


def local_auction(people: list[int], partners: list[np.ndarray], scores: list[np.ndarray], bounds: np.ndarray, prices: dict[int, float], held: dict[int, int], step: float) -> tuple[dict[int, int], list[int]]:
    """Bids of a group until every row has a partner or a list that has run out: (row of each partner, rows that ran out).

    prices rise in place; held: the rows of the group that have a partner already, by partner.
    """
    row_of = dict(held)
    with_partner = set(held.values())
    # Those whose lists are best first: any order gives an assignment within the step.
    waiting = [i for i in range(len(people)) if i not in with_partner]
    heapq.heapify(waiting)
    stale = []
    while waiting:
        i = heapq.heappop(waiting)
        value = scores[i] - np.fromiter((prices[j] for j in partners[i]), float, len(partners[i]))
        at = int(value.argmax())
        best = value[at]
        if best < bounds[i]:
            stale.append(i)
            continue
        value[at] = -np.inf
        second = max(float(value.max()), bounds[i])
        j = int(partners[i][at])
        prices[j] += (best - second if np.isfinite(second) else 0.0) + step
        if j in row_of:
            heapq.heappush(waiting, row_of[j])
        row_of[j] = i
    return row_of, stale


def _group_bids(steps: list[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group's auction, through phases of falling steps or until a list has run out."""

    def bid(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("person")
        people = group["person"].tolist()
        partners = [np.asarray(p, np.int64) for p in group["partners"]]
        scores, bounds = [np.asarray(s, float) for s in group["scores"]], group["bound"].to_numpy()
        prices = {int(j): float(c) for p, cs in zip(partners, group["prices"], strict=True) for j, c in zip(p, cs, strict=True)}
        before = dict(prices)
        held = {int(j): i for i, j in enumerate(group["held"].tolist()) if j is not None and not pd.isna(j)}
        for j, c in zip(group["held"].tolist(), group["held_price"].tolist(), strict=True):
            if j is not None and not pd.isna(j):
                prices.setdefault(int(j), float(c))
        for phase, step in enumerate(steps):
            row_of, stale = local_auction(people, partners, scores, bounds, prices, held if phase == 0 else {}, step)
            if stale:
                break
        rows = [(people[i], j, prices[j], False, phase) for j, i in row_of.items()]
        rows += [(people[i], None, None, True, phase) for i in stale]
        # What has become dearer without a row of its own here keeps its price.
        rows += [(None, j, c, False, phase) for j, c in prices.items() if j not in row_of and c > before.get(j, c)]
        frame = pd.DataFrame(rows, columns=["person", "partner", "price", "stale", "phase"])
        return frame.astype({"person": "Int64", "partner": "Int64", "price": float, "stale": bool, "phase": "int32"})

    return bid


def assign(left: DataFrame, right: DataFrame, scores: Scores, listed: int = LISTED, group: int = GROUP, last_step: float = LAST_STEP) -> DataFrame:
    """``(sample_id, matched, score, price, profit)``: partners of left rows among as many right rows, (sample_id, v) both.

    The sum of scores is the largest there is to within rows x last_step x the scores' range: price + profit sums to that bound.
    """
    left, right = (cut_lineage(df.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("v").cast("array<double>").alias("v"))) for df in (left, right))
    n, other = left.count(), right.count()
    if n != other:
        raise ValueError(f"sides differ in size: {n} and {other}")
    spark = left.sparkSession
    if n == 0:
        return spark.createDataFrame([], "sample_id long, matched long, score double, price double, profit double")
    lists = _lists(left, right, None, scores, listed)
    low, high = lists.agg(F.min(F.array_min("scores")), F.max(F.array_max("scores"))).first()
    span = max(high - low, abs(high) * 1e-9, 1e-300)
    steps = [span * FIRST_STEP]
    while steps[-1] > span * last_step:
        steps.append(max(steps[-1] / FALL, span * last_step))
    groups = -(-n // group)
    prices = spark.createDataFrame([], "partner long, price double")
    held = spark.createDataFrame([], "person long, held long, held_price double")
    for turn in range(MAX_ROUNDS):
        listed_rows = lists.select("person", F.posexplode("partners").alias("place", "partner"))
        known = listed_rows.join(prices, "partner", "left").groupBy("person")
        known = known.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("price", F.lit(0.0)).alias("price")))), lambda x: x["price"]).alias("prices"))
        dealt = lists.join(known, "person").join(held, "person", "left").withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "person"), F.lit(groups)))
        # One group is the whole problem, and goes through all phases at once.
        bids = cut_lineage(dealt.groupBy("group").applyInPandas(_group_bids(steps if groups == 1 else steps[:1]), BIDS))
        best = F.max(F.struct("price", (-F.coalesce("person", F.lit(2**62))).alias("low"))).alias("best")
        won = bids.where("partner is not null").groupBy("partner").agg(best).select("partner", F.col("best.price").alias("price"), (-F.col("best.low")).alias("person"))
        dearer = won.select("partner", "price")
        prices = cut_lineage(prices.withColumnRenamed("price", "old").join(dearer, "partner", "full").select("partner", F.greatest("price", "old").alias("price")))
        held = cut_lineage(won.where(F.col("person") < 2**62).select("person", F.col("partner").alias("held"), F.col("price").alias("held_price")))
        phase, stale = bids.agg(F.max("phase"), F.count_if("stale")).first()
        steps = steps[phase:]
        if stale:
            # Where some lists run out others are about to: all are made again, longer, until they are as long as lists get.
            old = (bids.where("stale") if listed >= MOST_LISTED else lists).select("person")
            listed = min(2 * listed, MOST_LISTED)
            again = _lists(left.join(old.select(F.col("person").alias("sample_id")), "sample_id", "left_semi"), right, prices, scores, listed)
            lists = cut_lineage(lists.join(old, "person", "left_anti").union(again))
        elif held.count() == n:
            if len(steps) == 1:
                break
            steps, held = steps[1:], held.where("false")
    else:
        raise RuntimeError(f"rows are without a partner after {MAX_ROUNDS} rounds")
    best = _lists(left, right, prices, scores, 1)
    profits = best.select(F.col("person").alias("sample_id"), F.col("partners")[0].alias("partner"), F.col("scores")[0].alias("score")).join(prices, "partner", "left")
    profits = profits.select("sample_id", (F.col("score") - F.coalesce("price", F.lit(0.0))).alias("profit"))
    own = lists.select("person", F.explode(F.arrays_zip("partners", "scores")).alias("x")).select("person", F.col("x.partners").alias("held"), F.col("x.scores").alias("score"))
    matched = held.join(own, ["person", "held"]).select(F.col("person").alias("sample_id"), F.col("held").alias("matched"), "score", F.col("held_price").alias("price"))
    return matched.join(profits, "sample_id")
