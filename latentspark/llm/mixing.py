"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's share of the token budget is its weight's part of all words, but at
most ``max_epochs`` times its own words; what a clamped source can't use is
dealt to the others in proportion to their weights until no source is above its
cap. A source then takes whole repetitions of every document and one fractional
repetition: documents in the order of a seeded hash, up to the hash bucket where
the words taken come nearest to the target.

The only wide data are per-source word sums over ``BUCKETS`` hash buckets, which
are combined on the map side; a source with a third of all rows is never
gathered. Sources are ranked and levelled by aggregates and a range-partitioned
running sum, not in one task.

Defined cases: a null text has size 0 and takes 0; an empty table gives an empty
result; a null source is a source of its own, ranked last; repeated rows are
separate documents with equal hash, taken together; sources without words have
target 0; other columns are kept by ``mix_rows`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.llm.common import count_words, cut_lineage, in_one_column

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash buckets of the fractional repetition: 4 hexadecimal digits of an MD5.
BUCKETS = 1 << 16
#: Buckets of one run of the running sums.
RUN = 1 << 8
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_SOURCES = 50_000


def _bucket(doc_id: Column, seed: str) -> Column:
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0, by code point with null last, by ranges of sources and not in one task."""
    laid = cut_lineage(
        sources.withColumn("last", F.col("source").isNull().cast("int")).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    )
    before = laid.groupBy("part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    return laid.join(F.broadcast(before), "part").withColumn("rank", inside - 1 + F.coalesce("before", F.lit(0))).drop("part", "before", "last")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``weight`` and ``target double`` to ``(source, source_size)`` rows.

    Each round clamps the sources that the present level overfills and spreads the
    rest; rounds end when none is above its cap, at most one for each clamped source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut_lineage(_ranked(sources).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs))
    total, weight_sum = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    clamped, left, level = -1, total or 0, 0.0
    while weight_sum:
        level = left / weight_sum
        above = F.col("cap") < F.lit(level) * F.col("weight")
        n, used, weight_used = sources.where(above).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if n == clamped or not n:
            break
        clamped, left = n, total - used
        weight_sum = sources.agg(F.sum("weight")).first()[0] - weight_used
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))).drop("cap", "rank")


def _plan(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """For each source: target, whole repetitions and the last bucket of the fractional one (-1: none)."""
    sums = cut_lineage(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    targets = cut_lineage(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * size))
    # Running sums in two levels, so that no task gets all buckets of a large source.
    part = F.floor(F.col("bucket") / RUN)
    inside = F.sum("words").over(Window.partitionBy("source", "part").orderBy("bucket"))
    parts = sums.withColumn("part", part).groupBy("source", "part").agg(F.sum("words").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("in"), F.col("part").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    runs = sums.withColumn("part", part).withColumn("inside", inside).join(parts, F.col("source").eqNullSafe(F.col("in")) & (F.col("part") == F.col("at")))
    gap = runs.withColumn("running", F.col("inside") + F.col("before")).join(targets.select(F.col("source").alias("of"), "need"), F.col("source").eqNullSafe(F.col("of")))
    best = gap.groupBy("of").agg(F.min(F.struct(F.abs(F.col("running") - F.col("need")).alias("gap"), "bucket")).alias("best"), F.first("need").alias("needed"))
    cut = best.select("of", F.when(F.col("best.gap") < F.col("needed"), F.col("best.bucket")).otherwise(-1).alias("last_bucket"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("__source"), "source_size", "target", "whole", F.coalesce("last_bucket", F.lit(-1)).alias("last_bucket"))


def _with_plan(rows: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """Joins each row with its source's plan; both ways give the same rows."""
    plan = cut_lineage(plan)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col(source).eqNullSafe(F.col("__source")))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, repeats, taken)`` of every row of docs."""
    sized = cut_lineage(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), _bucket(F.col("doc_id"), seed).alias("bucket")))
    rows = _with_plan(sized, "source", _plan(sized, weights, max_epochs))
    repeats = (F.col("whole") + (F.col("bucket") <= F.col("last_bucket")).cast("long")).alias("repeats")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", repeats)
    return rows.withColumn("taken", F.col("size") * F.col("repeats"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    sized = docs.select(F.col("source"), count_words(F.col("text")).alias("size"), _bucket(F.col("doc_id"), seed).alias("bucket"))
    plan = _plan(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), weights, max_epochs)
    rows = _with_plan(docs.select(in_one_column(docs), "source", _bucket(F.col("doc_id"), seed).alias("bucket")), "source", plan)
    repeats = (F.col("whole") + (F.col("bucket") <= F.col("last_bucket")).cast("long")).cast("int")
    times = F.when(repeats > 0, F.sequence(F.lit(1), repeats)).otherwise(F.array().cast("array<int>"))
    return rows.select("row", F.explode(times).alias("time")).select("row.*")
