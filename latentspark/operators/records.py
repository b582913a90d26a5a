"""Operators over metric records: averages in two levels, best rows, pivots, gaps and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarise(records: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """One level: count, mean and population deviation."""
    return records.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def two_level(records: DataFrame, by: Sequence[str], within: Sequence[str], metric: str) -> DataFrame:
    """Mean within (by, within), then count, mean and population deviation across; null metrics are skipped."""
    inner = records.where(F.col(metric).isNotNull()).groupBy(*by, *within).agg(F.avg(metric).alias("inner"))
    return inner.groupBy(*by).agg(F.count("inner").alias("n"), F.avg("inner").alias("mean"), F.stddev_pop("inner").alias("std"))


#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T975 = (
    12.7062047362, 4.3026527297, 3.1824463053, 2.7764451052, 2.5705818356, 2.4469118511, 2.3646242516, 2.3060041352, 2.2621571628, 2.2281388520,
    2.2009851601, 2.1788128297, 2.1603686565, 2.1447866879, 2.1314495456, 2.1199052992, 2.1098155778, 2.1009220402, 2.0930240544, 2.0859634473,
    2.0796138447, 2.0738730679, 2.0686576104, 2.0638985616, 2.0595385528, 2.0555294386, 2.0518305165, 2.0484071418, 2.0452296421, 2.0422724563,
)
#: The same quantile of the normal distribution, and the coefficients of 1/n, 1/n^2, ... by which t exceeds it.
Z975 = 1.959963984540054
EXCESS = (
    (Z975**3 + Z975) / 4, (5 * Z975**5 + 16 * Z975**3 + 3 * Z975) / 96, (3 * Z975**7 + 19 * Z975**5 + 17 * Z975**3 - 15 * Z975) / 384,
    (79 * Z975**9 + 776 * Z975**7 + 1482 * Z975**5 - 1920 * Z975**3 - 945 * Z975) / 92160,
)


def t_quantile(freedom: Column) -> Column:
    """Two-sided 95 % quantile of Student's t; beyond the table by its series, which is off by less than 1e-7."""
    n = freedom.cast("double")
    series = F.lit(Z975)
    for power, c in enumerate(EXCESS, 1):
        series = series + c / F.pow(n, power)
    return F.when(freedom > len(T975), series).when(freedom > 0, F.get(F.array(*[F.lit(t) for t in T975]), (freedom - 1).cast("int")))


def mean_and_interval(records: DataFrame, by: Sequence[str], within: Sequence[str], metric: str) -> DataFrame:
    """Two levels with a 95 % half-width t * sample deviation / sqrt(n); 0 where n is 1."""
    inner = records.where(F.col(metric).isNotNull()).groupBy(*by, *within).agg(F.avg(metric).alias("inner"))
    out = inner.groupBy(*by).agg(F.count("inner").alias("n"), F.avg("inner").alias("mean"), F.stddev_pop("inner").alias("std"), F.stddev_samp("inner").alias("sample"))
    return out.withColumn("ci95", F.when(F.col("n") < 2, 0.0).otherwise(t_quantile(F.col("n") - 1) * F.col("sample") / F.sqrt("n"))).drop("sample")


def best_rows(records: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in the order given; callers end the order with a unique column."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return records.withColumn("__place", place).where("__place = 1").drop("__place")


#: Keys of a schedule that are sent to every wanted row.
MAX_KEYS = 10_000


def nearest_in_log(wanted: DataFrame, have: DataFrame, key: str, nearest: bool = True) -> DataFrame:
    """For each wanted row the have row of equal key, else of the nearest logarithm (the smaller key on ties).

    nearest False: a wanted key that have lacks is an error. have is a schedule of at most MAX_KEYS budgets; only its
    keys meet the wanted rows.
    """
    found = [r[0] for r in have.select(key).distinct().orderBy(key).limit(MAX_KEYS + 1).collect()]
    if len(found) > MAX_KEYS:
        raise ValueError(f"a schedule of more than {MAX_KEYS} keys")
    if not nearest:
        lacking = [r[0] for r in wanted.select(key).distinct().where(~F.col(key).isin(found)).limit(5).collect()]
        if lacking:
            raise KeyError(f"nothing was measured at {key} {lacking}; measured: {found}")
    keys = F.array(*[F.lit(k) for k in found]) if found else F.array().cast("array<long>")
    gap = F.transform(keys, lambda k: F.struct(F.abs(F.log(k.cast("double")) - F.log(F.col(key).cast("double"))).alias("gap"), k.alias("key")))
    return wanted.withColumn("used", F.array_min(gap)["key"]).join(have.withColumnRenamed(key, "used"), "used")


def ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
    """rows with ``place``: 1 for the largest score, the first name on ties.

    A table of methods: its places are counted in groups that are joined in, not in one partition.
    """
    spread = rows.select(F.col(score).alias("__s"), F.col(name).alias("__n")).groupBy("__s").agg(F.sort_array(F.collect_list("__n")).alias("__names"))
    scores = F.sort_array(F.collect_list(F.struct("__s", F.size("__names").alias("n"))), False).alias("__all")
    above = spread.agg(scores)  # one row: the distinct scores of the methods compared
    met = rows.crossJoin(above).join(spread, F.col(score) == F.col("__s"))
    ahead = F.aggregate(F.filter("__all", lambda x: x["__s"] > F.col(score)), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return met.withColumn("place", ahead + F.array_position("__names", F.col(name))).drop("__all", "__s", "__names")


def paired_deltas(cells: DataFrame, highlight: str, keys: Sequence[str], metric: str, noise_floor: float = 0.0) -> DataFrame:
    """Of each other method the difference to the highlighted one over cells both have.

    A tie is a mean within two standard errors of 0, or of a single cell one below the noise floor.
    """
    ours = cells.where(F.col("method") == highlight).select(*keys, F.col(metric).alias("__ours"))
    delta = F.col(metric) - F.col("__ours")
    met = cells.where(F.col("method") != highlight).join(ours, list(keys)).withColumn("delta", delta)
    out = met.groupBy("method").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("std"), F.sum((F.col("delta") > 0).cast("long")).alias("wins"))
    return out.withColumn("tie", F.when(F.col("n") > 1, F.abs("mean") <= 2 * F.col("std") / F.sqrt("n")).otherwise(F.abs("mean") < noise_floor))


def margins(cells: DataFrame, ours: str, by: Sequence[str], metric: str) -> DataFrame:
    """Ours less the best rival, and its name, of groups that have both; the first name on ties."""
    mine = F.max(F.when(F.col("method") == ours, F.col(metric))).alias("ours")
    rival = F.min(F.when(F.col("method") != ours, F.struct((-F.col(metric)).alias("minus"), F.col("method").alias("name")))).alias("rival")
    out = cells.groupBy(*by).agg(mine, rival).where(F.col("ours").isNotNull() & F.col("rival").isNotNull())
    return out.select(*by, (F.col("ours") + F.col("rival.minus")).alias("margin"), F.col("rival.name").alias("rival"))


def missing_cells(expected: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected key rows that have lacks; nulls equal nulls."""
    condition = [F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return expected.alias("e").join(have.select(*keys).distinct().alias("h"), condition, "left_anti")


def repeated_cells(have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return have.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_whole_grid(expected: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """have, if it holds each expected cell and none twice; an error that names some of them otherwise."""
    for what, rows in (("missing", missing_cells(expected, have, keys)), ("repeated", repeated_cells(have, keys))):
        if some := rows.select(*keys).limit(5).collect():
            raise ValueError(f"{what} cells: {[tuple(r) for r in some]}")
    return have


def merge_summary(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows, and old rows of methods that were not run again."""
    return old.join(fresh.select("method").distinct(), "method", "left_anti").unionByName(fresh, allowMissingColumns=True)


def split_columns(rows: DataFrame, keep: Sequence[str], methods: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``{method}_{metric}`` columns as rows of (method, metric, value); a column that isn't there is an error."""
    if lacking := [f"{m}_{x}" for m in methods for x in metrics if f"{m}_{x}" not in rows.columns]:
        raise ValueError(f"columns that the records lack: {lacking}")
    parts = ", ".join(f"'{m}', '{x}', CAST({m}_{x} AS DOUBLE)" for m in methods for x in metrics)
    return rows.selectExpr(*keep, f"stack({len(methods) * len(metrics)}, {parts}) AS (method, metric, value)")


def read_back(rows: DataFrame, keys: Sequence[str], methods: Sequence[str], swept: str, metrics: Sequence[str], select: str, written: str) -> DataFrame:
    """``(keys..., lam, method, metric, value)`` of each cell's row of the largest ``{select}_mean``, the lambda that the swept method would be run at.

    Several files may hold rows of a cell: of equal ones the first by ``written`` counts, and rows without the metric don't.
    The swept method's values are in ``{metric}_mean``, those of others in ``{method}_{metric}``; a column that isn't there is an error.
    """
    found = rows.where(F.col(f"{select}_mean").isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(f"{select}_mean"), written, "lam"))
    best = found.withColumn("_place", place).where("_place = 1").drop("_place")
    if lacking := [f"{x}_mean" for x in metrics if f"{x}_mean" not in rows.columns]:
        raise ValueError(f"columns that the records lack: {lacking}")
    own = best.withColumns({f"{swept}_{x}": F.col(f"{x}_mean") for x in metrics})
    return split_columns(own, [*keys, "lam"], methods, metrics)


def beside(rows: DataFrame, baselines: DataFrame, methods: Sequence[str], keys: Sequence[str], metric: str) -> DataFrame:
    """Each row with the baselines' metric of its keys as columns ``{method}_{metric}``."""
    wide = baselines.groupBy(*keys).pivot("method", list(methods)).agg(F.avg(metric))
    return rows.join(wide.select(*keys, *(F.col(m).alias(f"{m}_{metric}") for m in methods)), list(keys), "left")


def drop_cells(records: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Rows but those of a dropped ``method`` or ``method:design``."""
    out = records
    for spec in specs:
        method, _, design = spec.partition(":")
        gone = F.col("method") == method
        out = out.where(~(gone & (F.col("strategy") == design) if design else gone))
    return out


def registry_filter(frame: DataFrame, family: str | None = None, macro_family: str | None = None, model_name: str | None = None, cached: bool = False, min_dim: int | None = None, max_dim: int | None = None, max_params: int | None = None) -> DataFrame:
    """All conditions that are given; patterns are case-insensitive, nulls drop out."""
    for column, pattern in (("family", family), ("macro_family", macro_family), ("model_name", model_name)):
        if pattern is not None:
            frame = frame.where(F.col(column).rlike(f"(?i){pattern}"))
    bounds = (("latent_dim", min_dim, 1), ("latent_dim", max_dim, -1), ("num_parameters", max_params, -1))
    for column, bound, sign in bounds:
        if bound is not None:
            frame = frame.where(sign * F.col(column) >= sign * bound)
    return frame.where("cached") if cached else frame


def registry_summary(frame: DataFrame) -> DataFrame:
    """By latent_dim: models, cached ones, families (null is one), and their sorted names."""
    families = F.countDistinct("family") + F.max(F.col("family").isNull().cast("int"))
    return frame.groupBy("latent_dim").agg(
        F.count("*").alias("n_models"), F.sum(F.col("cached").cast("long")).alias("n_cached"), families.alias("n_families"),
        F.array_join(F.array_sort(F.collect_set("family")), ", ").alias("families"),
    )
