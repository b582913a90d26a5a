"""Grids of fits: a cell is one map, chart, rate, budget, design and seed of one pair.

A grid is a list of cells; ``run_cells`` fits and scores those that earlier records
lack. Pilots are selected once for each source, design and seed at the largest
budget. A fitted cell is one record on the driver, whatever the size of the tables.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentspark.functions.kernels import Kernel
from latentspark.operators import experiment, metrics
from latentspark.operators.align.base import Aligner
from latentspark.operators.blocks import cut_lineage
from latentspark.operators.decoders import RidgeProbe
from latentspark.operators.pilots import select_pilot_path
from latentspark.operators.records import best_rows
from latentspark.operators.selection import first_by_hash


class Cell(NamedTuple):
    """chart and variant are names of settings; symbols None: uncut; n_pilots None: the whole pool; design: a name, or name@scale for a kernel of that width."""

    source: str
    target: str
    method: str
    chart: str | None = None
    variant: str | None = None
    symbols: int | None = None
    n_pilots: int | None = None
    design: str | None = None
    seed: int = 0


SCORES = ("mse", "nmse", "r2", "cosine", "mrr", "top1", "top5", "top10")
PROBED = ("accuracy", "oracle", "ratio")
FITTED = ("lam", "capacity", "gram_cond", "gram_flatness", "residual_r2")
_WHOLE = ("symbols", "n_pilots", "seed", "paired_used", "delivered", "map_params")
COLUMNS = (*Cell._fields, "delivered", "paired_used", "map_params", "coverage", *SCORES, *PROBED, *FITTED)
_TEXT = ("source", "target", "method", "chart", "variant", "design")
RECORD = T.StructType([T.StructField(c, T.StringType() if c in _TEXT else T.LongType() if c in _WHOLE else T.DoubleType()) for c in COLUMNS])


def cells(pairs: Iterable[tuple[str, str]], methods: Iterable[str], charts: Iterable[str | None] = (None,), variants: Iterable[str | None] = (None,), symbols: Iterable[int | None] = (None,), budgets: Iterable[int | None] = (None,), designs: Iterable[str | None] = (None,), seeds: Iterable[int] = (0,)) -> list[Cell]:
    """The product of the axes; a design that isn't named is the method's own."""
    out = []
    for (source, target), method, chart, variant, k, n, design, seed in itertools.product(pairs, methods, charts, variants, symbols, budgets, designs, seeds):
        out.append(Cell(source, target, method, chart, variant, k, n, None if n is None else design or experiment.PRESETS[method].design, seed))
    return list(dict.fromkeys(out))


def _paths(pool: DataFrame, wanted: Mapping[tuple[str, int], set[int]]) -> dict[tuple[str, int, int], DataFrame]:
    """Pilot ids by (design, seed, budget)."""
    found = {}
    for (design, seed), budgets in wanted.items():
        name, _, scale = design.partition("@")
        path = cut_lineage(select_pilot_path(pool, sorted(budgets), name, seed, Kernel(scale=float(scale)) if scale else None))
        for n in budgets:
            found[design, seed, n] = path.where(F.col("budget") == n).select("sample_id")
    return found


def _fitted(aligner: Aligner, predicted: DataFrame, src: DataFrame, tgt: DataFrame) -> dict[str, float | None]:
    """What a kernel map says of its fit, and the share of the rigid stage's error that the rest explains (0 for a rigid map)."""
    out = {k: float(v) for k, v in aligner.diagnostics().items() if k in FITTED} if hasattr(aligner, "diagnostics") else {}
    if hasattr(aligner, "transform_linear"):
        rigid = aligner.transform_linear(src.select("sample_id", "v"))
        rows = predicted.withColumnRenamed("v", "full").join(rigid.withColumnRenamed("v", "rigid"), "sample_id").join(tgt.select("sample_id", F.col("v").cast("array<double>").alias("t")), "sample_id")
        out["residual_r2"] = metrics.residual_r2(rows).first()[0]
    return out


class Study(NamedTuple):
    """What all cells of a grid share.

    agents: (sample_id, label, split, v) by name. charts, variants: settings by name. probes: classifiers by target.
    pool_size: candidates of the pilots, by hash. context: scalers learn from the whole train split. flush is given the new
    records of each pair and method.
    """

    agents: Mapping[str, DataFrame]
    charts: Mapping[str, Mapping] = {}
    variants: Mapping[str, Mapping] = {}
    probes: Mapping[str, RidgeProbe] = {}
    pool_size: int | None = None
    context: bool = True
    flush: Callable[[DataFrame], None] | None = None
    label: str = "label"


def run_cells(spark: SparkSession, study: Study, wanted: Sequence[Cell], done: DataFrame | None = None, lams: Sequence[float] | None = None) -> DataFrame:
    """Records of the wanted cells, those of ``done`` included.

    lams: every cell's kernel map is fitted once and solved for each of them, a record each; a cell that lacks any of its
    records is run again as a whole. Cells whose design leaves fewer pilots than their budget are left out.
    """
    have: dict[Cell, set] = defaultdict(set)
    if done is not None:
        for *cell, lam in done.select(*Cell._fields, "lam").distinct().collect():  # one row a record
            have[Cell(*cell)].add(lam)
    todo = [c for c in wanted if c not in have or (lams and not set(map(float, lams)) <= have[c])]
    if done is not None and lams:
        done = done.where(~F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in Cell._fields)).isin(["|".join("-" if v is None else str(v) for v in c) for c in todo]))
    records: list[tuple] = []
    for source, mine in _by(todo, lambda c: c.source).items():
        train = study.agents[source].where("split = 'train'")
        pool = train if study.pool_size is None else first_by_hash(train, study.pool_size).drop("place")
        budgets = defaultdict(set)
        for c in mine:
            if c.n_pilots is not None:
                budgets[c.design, c.seed].add(c.n_pilots)
        if budgets:
            experiment.check_budgets_fit_pool(sorted(set.union(*budgets.values())), pool.count())
        paths = _paths(pool, budgets)
        for block in _by(mine, lambda c: (c.target, c.method)).values():
            fresh = []
            for c in block:
                pilots = pool.select("sample_id") if c.n_pilots is None else paths[c.design, c.seed, c.n_pilots]
                fresh += _run(study, c, pilots, lams)
            if study.flush is not None and fresh:
                study.flush(spark.createDataFrame(fresh, RECORD))
            records += fresh
    out = spark.createDataFrame(records, RECORD)
    return out if done is None else done.unionByName(out, allowMissingColumns=True)


def _by(items: Iterable[Cell], key) -> dict:
    out = defaultdict(list)
    for x in items:
        out[key(x)].append(x)
    return out


def _run(study: Study, c: Cell, pilots: DataFrame, lams: Sequence[float] | None) -> list[tuple]:
    src, tgt = study.agents[c.source], study.agents[c.target]
    src_train, tgt_train = (df.where("split = 'train'") for df in (src, tgt))
    src_test, tgt_test = (df.where("split = 'test'") for df in (src, tgt))
    sides = [cut_lineage(df.join(pilots, "sample_id", "left_semi")) for df in (src_train, tgt_train)]
    if c.n_pilots is not None and sides[0].count() < c.n_pilots:
        return []
    classes = [df.select(F.count_distinct(study.label)).first()[0] for df in (sides[0], tgt_test)] if study.label in src.columns and study.label in tgt.columns else [0, 0]
    aligner = experiment.aligner_of(c.method, study.charts[c.chart] if c.chart else None, c.symbols, c.seed, study.variants[c.variant] if c.variant else None)
    solve = lams if lams and hasattr(aligner, "set_lam") else None
    if solve:
        aligner.lam = float(solve[0])
    aligner.fit(*sides, **({"src_context": src_train, "tgt_context": tgt_train} if study.context else {}))
    out = []
    for lam in solve or (None,):
        if lam is not None:
            aligner.set_lam(float(lam))
        predicted = cut_lineage(aligner.transform(src_test.select("sample_id", "v")))
        row = metrics.alignment(predicted, tgt_test.select("sample_id", "v")).first().asDict()
        if (probe := study.probes.get(c.target)) is not None:
            row |= metrics.probed(probe, predicted, tgt_test, study.label).first().asDict()
        row |= _fitted(aligner, predicted, src_test, tgt_test)
        costs = aligner.summary()
        row |= c._asdict() | {"delivered": int(costs["symbols"]), "paired_used": int(costs["paired_used"]), "map_params": int(costs["map_params"]), "coverage": classes[0] / classes[1] if classes[1] else None}
        out.append(tuple(row.get(name) for name in COLUMNS))
    return out


def averaged(records: DataFrame, by: Sequence[str], scores: Sequence[str] = ("accuracy", "top1", "mrr", "nmse")) -> DataFrame:
    """Mean scores over pairs and seeds of each group, the cells behind them, and the smallest rate that any pair delivered."""
    return records.groupBy(*by).agg(F.count("*").alias("cells"), F.min("delivered").alias("delivered"), *(F.avg(s).alias(s) for s in scores))


def method_grid(pairs: Sequence[tuple[str, str]], methods: Sequence[str], n_pilots: int, repeats: int) -> list[Cell]:
    """Every method on every pair and repeat, with the pilots of its own design."""
    return cells(pairs, methods, budgets=[n_pilots], seeds=range(repeats))


def rate_grid(pairs: Sequence[tuple[str, str]], methods: Sequence[str], symbols: Sequence[int | None], n_pilots: int, charts: Sequence[str | None] = (None,), design: str | None = None, seeds: Sequence[int] = (0,)) -> list[Cell]:
    """Methods by rate and chart: the compression and dimension studies."""
    return cells(pairs, methods, charts, symbols=symbols, budgets=[n_pilots], designs=[design], seeds=seeds)


def design_grid(pairs: Sequence[tuple[str, str]], methods: Sequence[str], designs: Sequence[str], budgets: Sequence[int], symbols: int | None = None, seeds: Sequence[int] = (0,)) -> list[Cell]:
    """Designs by budget and method."""
    return cells(pairs, methods, symbols=[symbols], budgets=budgets, designs=designs, seeds=seeds)


def kernel_variants(names: Sequence[str], scales: Sequence[float]) -> dict[str, dict]:
    """Settings of each kernel at each width, by name."""
    return {f"{n}-{s:g}": {"kernel": Kernel(n, scale=float(s))} for n in names for s in scales}


def kernel_grid(pairs: Sequence[tuple[str, str]], variants: Mapping[str, Mapping], n_pilots: int, design: str = "herding", seeds: Sequence[int] = (0,)) -> list[Cell]:
    """Kernels of the residual stage, beside the rigid map on the same pilots."""
    return cells(pairs, ["procrustes"], budgets=[n_pilots], designs=[design], seeds=seeds) + cells(pairs, ["rkhs"], variants=list(variants), budgets=[n_pilots], designs=[design], seeds=seeds)


def surface_grid(pairs: Sequence[tuple[str, str]], variants: Sequence[str | None], budgets: Sequence[int], method: str = "rkhs", design: str | None = None, baselines: Sequence[str] = ("procrustes",), seeds: Sequence[int] = (0,)) -> list[Cell]:
    """A kernel map by width and budget, to be solved along a lambda axis, and the maps that it is drawn against."""
    return cells(pairs, [method], variants=variants, budgets=budgets, designs=[design], seeds=seeds) + cells(pairs, baselines, budgets=budgets, designs=[design], seeds=seeds)


def pilot_width_grid(pairs: Sequence[tuple[str, str]], scales: Sequence[float], n_pilots: int, method: str = "rkhs", seeds: Sequence[int] = (0,)) -> list[Cell]:
    """Widths of the herding kernel, the map held fixed."""
    return cells(pairs, [method], budgets=[n_pilots], designs=[f"herding@{s:g}" for s in scales], seeds=seeds)


#: The residual stage with its constraint, without it, and without the rigid stage.
ABLATION = ("rkhs", "rkhs_free", "krr")


def ablation_grid(pairs: Sequence[tuple[str, str]], budgets: Sequence[int], design: str = "herding", seeds: Sequence[int] = (0,)) -> list[Cell]:
    """The three variants side by side, and the rigid map that their gain is taken over."""
    return cells(pairs, ["procrustes", *ABLATION], budgets=budgets, designs=[design], seeds=seeds)


def gains(records: DataFrame, over: str = "procrustes", scores: Sequence[str] = ("accuracy", "top1", "mrr")) -> DataFrame:
    """Each record's scores less those of the map ``over`` of the same pair, budget, design and seed."""
    keys = ["source", "target", "n_pilots", "design", "seed"]
    base = records.where(F.col("method") == over).select(*keys, *(F.col(s).alias(f"__{s}") for s in scores))
    met = records.where(F.col("method") != over).join(base, keys)
    return met.select("method", "variant", *keys, *((F.col(s) - F.col(f"__{s}")).alias(f"{s}_gain") for s in scores))


def oracle_lambda(records: DataFrame, score: str = "accuracy") -> DataFrame:
    """Of each cell solved along a lambda axis the record of the best score, the smaller lambda on ties: what no selection can beat."""
    return best_rows(records.where(F.col("lam").isNotNull()), Cell._fields, F.col(score).desc(), F.col("lam"))
