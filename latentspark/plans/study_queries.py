"""Queries of the studies' steps over metric records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import experiment, selection, studies
from latentspark.plans.record_queries import REC, REG, _round
from latentspark.plans.registry import query
from latentspark.sources import fixtures as X
from latentspark.sources.tables import repo_id

#: Records with a rate: null symbols are uncompressed.
RATED = REC + ", q AS (SELECT *, CASE WHEN n_pilots > 2048 THEN NULL ELSE CAST(n_pilots / 16 + seed AS BIGINT) END AS symbols FROM r)"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    return r.withColumn("symbols", F.when(F.col("n_pilots") <= 2048, (F.col("n_pilots") / 16 + F.col("seed")).cast("long")))


@query(REC + ", b AS (SELECT log_lam FROM r WHERE score IS NOT NULL ORDER BY score DESC, event_id LIMIT 1) SELECT event_id, method, log_lam, round(score, 6) AS score FROM r WHERE log_lam = (SELECT log_lam FROM b)")
def curve_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.records(spark, sf_dir).select("event_id", "method", "log_lam", "score")
    return _round(studies.curve_at_best(rows, "log_lam", "score", "event_id"), "score")


@query(RATED + " SELECT event_id, method, n_pilots FROM q WHERE symbols IS NULL")
def uncompressed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.at_symbols(_rated(spark, sf_dir), None).select("event_id", "method", "n_pilots")


@query(REC + ", m AS (SELECT min(method) AS b FROM r), g AS (SELECT pairs, max(score) FILTER (method <> b) AS best, max(score) FILTER (method = b) AS baseline FROM r, m GROUP BY pairs) SELECT pairs, round(best, 6) AS best, round(baseline, 6) AS baseline, round(best - baseline, 6) AS gain FROM g")
def gain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    return _round(studies.gains(r, ["pairs"], r.agg(F.min("method")).first()[0], "score"), "best", "baseline", "gain")


@query(REC + ", s AS (SELECT method, log_lam, avg(score) AS score, avg(score * score) AS power FROM r GROUP BY ALL) SELECT method, round(max(score), 6) AS score_peak, round(arg_max(score, log_lam), 6) AS score_last, round(max(power), 4) AS power_peak, round(arg_max(power, log_lam), 4) AS power_last FROM s GROUP BY method")
def ablation_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = X.records(spark, sf_dir).groupBy("method", "log_lam").agg(F.avg("score").alias("score"), F.avg(F.col("score") * F.col("score")).alias("power"))
    return _round(_round(studies.peaks(curves, "method", "log_lam", ["score", "power"]), "score_peak", "score_last"), "power_peak", "power_last", places=4)


@query(REC + ", s AS (SELECT method, pairs, seed, avg(score) AS score FROM r GROUP BY ALL) SELECT count(*) AS n, round(max(abs(a.score - b.score)), 6) AS score FROM s a JOIN s b ON a.method = b.method AND a.pairs = b.pairs AND a.seed = 0 AND b.seed = 1")
def reproducibility_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.records(spark, sf_dir).groupBy("method", "pairs", "seed").agg(F.avg("score").alias("score"))
    return _round(studies.largest_difference(s.where("seed = 0"), s.where("seed = 1"), ["method", "pairs"], ["score"]), "score")


def _compression_sql(cast: str) -> str:
    return RATED + f" SELECT method, strategy, n_pilots, count(*) AS n, {cast} AS symbols, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM q GROUP BY ALL"


@query(_compression_sql("CAST(trunc(avg(symbols)) AS BIGINT)"))
def compression_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.compression(_rated(spark, sf_dir), ["method", "strategy", "n_pilots"], "score"), "mean", "std")


@query(_compression_sql("CAST(round_even(avg(symbols), 0) AS BIGINT)"))
def compression_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.compression(_rated(spark, sf_dir), ["method", "strategy", "n_pilots"], "score", "round"), "mean", "std")


@query(RATED + " SELECT method, n_pilots, min(symbols) AS symbols, round(avg(score), 6) AS mean FROM q GROUP BY ALL")
def dimension_seed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.seed_average(_rated(spark, sf_dir), ["method", "n_pilots"], "score"), "mean")


@query(RATED + ", c AS (SELECT DISTINCT method, symbols, strategy FROM q), d AS (SELECT DISTINCT method, symbols, strategy FROM q WHERE event_id % 4 = 0) SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.method = c.method AND d.strategy = c.strategy AND d.symbols IS NOT DISTINCT FROM c.symbols)")
def resume_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rated(spark, sf_dir)
    return studies.pending(q.select("method", "symbols", "strategy").distinct(), q.where("event_id % 4 = 0"), ["method", "symbols", "strategy"])


@query(REC + """, p AS (SELECT DISTINCT pairs FROM r), m AS (SELECT DISTINCT method FROM r), n AS (SELECT DISTINCT n_pilots FROM r), l AS (SELECT DISTINCT log_lam FROM r)
SELECT p.pairs, count(*) AS missing FROM p, m, n, l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pairs = p.pairs AND r.method = m.method AND r.n_pilots = n.n_pilots AND r.log_lam = l.log_lam) GROUP BY p.pairs""")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.incomplete(X.records(spark, sf_dir), ["method", "n_pilots", "log_lam"], "pairs")


@query(REC + ", g AS (SELECT method, n_pilots, log_lam, count(DISTINCT seed) AS n FROM r GROUP BY ALL) SELECT n, count(*) AS groups FROM g GROUP BY n")
def uneven_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.uneven(X.records(spark, sf_dir), ["method", "n_pilots", "log_lam"], "seed")


@query(REC + ", s AS (SELECT method, pairs, seed, avg(score) AS score FROM r GROUP BY ALL) SELECT a.method, a.pairs, round(a.score, 6) AS score, round(b.score, 6) AS refit FROM s a JOIN s b ON a.method = b.method AND a.pairs = b.pairs AND a.seed = 0 AND b.seed = 1 WHERE abs(a.score - b.score) > 0.5")
def refit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.records(spark, sf_dir).groupBy("method", "pairs", "seed").agg(F.avg("score").alias("score"))
    off = studies.off_by(s.where("seed = 0").drop("seed"), s.where("seed = 1").drop("seed"), ["method", "pairs"], "score", 0.5)
    return _round(off, "score", "refit")


@query(REC + " SELECT method, min(event_id) AS first_seen FROM r GROUP BY method")
def facet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.first_seen(X.records(spark, sf_dir), "method", "event_id")


@query(REC + ", d AS (SELECT DISTINCT strategy, n_pilots FROM r) SELECT strategy, n_pilots, row_number() OVER (ORDER BY CASE strategy WHEN 'random' THEN 1 WHEN 'herding' THEN 2 ELSE 3 END, n_pilots DESC) AS place FROM d")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs in the order of a configuration, unknown ones last; a table of a few rows."""
    d = X.records(spark, sf_dir).select("strategy", "n_pilots").distinct()
    rows = d.withColumn("key", studies.in_listed_order(d, "strategy", ["random", "herding"])).orderBy("key", F.desc("n_pilots"), "strategy").collect()
    return spark.createDataFrame([(r.strategy, r.n_pilots, i + 1) for i, r in enumerate(rows)], "strategy string, n_pilots long, place long")


@query(REC + """, m AS (SELECT method, strategy, n_pilots, avg(score) AS mean FROM r WHERE score IS NOT NULL GROUP BY ALL)
SELECT method, strategy, n_pilots, round(mean, 6) AS mean, CAST(row_number() OVER w AS INTEGER) AS place, coalesce(n_pilots >= 2.5 * lag(n_pilots) OVER w, TRUE) AS marked FROM m WINDOW w AS (PARTITION BY method, strategy ORDER BY n_pilots)""")
def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.figure_rows(X.records(spark, sf_dir), ["method", "strategy"], "n_pilots", "score", 2.5), "mean")


@query(REC + ", m AS (SELECT strategy, method, n_pilots, avg(score) AS mean, stddev_pop(score) AS std, max(n_pilots) AS used FROM r GROUP BY ALL) SELECT strategy, method, n_pilots, round(mean, 6) AS mean, round(std, 6) AS std FROM m")
def design_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    return _round(r.groupBy("strategy", "method", "n_pilots").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")), "mean", "std")


@query(REC + ", p AS (SELECT pairs, avg(score) AS own FROM r GROUP BY pairs) SELECT round(avg(own), 6) AS native FROM p")
def native_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged by pair first, so that a receiver of many pairs counts as often."""
    return X.records(spark, sf_dir).groupBy("pairs").agg(F.avg("score").alias("own")).agg(F.round(F.avg("own"), 6).alias("native"))


@query(RATED + """ SELECT method, min(symbols) FILTER (n_pilots = 128) AS "128", min(symbols) FILTER (n_pilots = 1024) AS "1024", min(symbols) AS first_kept, max(symbols) AS last_kept FROM q GROUP BY method""")
def dimension_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _rated(spark, sf_dir)
    wide = q.groupBy("method").pivot("n_pilots", [128, 1024]).agg(F.min("symbols"))
    return wide.join(q.groupBy("method").agg(F.min("symbols").alias("first_kept"), F.max("symbols").alias("last_kept")), "method")


@query(REG + ", m AS (SELECT a.family AS source, b.family AS target, least(a.w, b.w) AS rank FROM (SELECT family, max(latent_dim) AS w FROM registry GROUP BY family) a JOIN (SELECT family, max(latent_dim) AS w FROM registry GROUP BY family) b ON a.family <> b.family) SELECT target, CAST(min(rank) AS BIGINT) AS max_rank, count(*) AS n_pairs FROM m GROUP BY target")
def usable_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest rank that every pair of a receiver can use."""
    w = X.registry(spark, sf_dir).groupBy("family").agg(F.max("latent_dim").alias("w"))
    return studies.usable_ranks(w, "family", "w")


@query(REC + ", w AS (SELECT pairs, min(log_lam) AS low, max(log_lam) AS high FROM r GROUP BY pairs) SELECT pairs, i AS place, round(pow(10.0, low + i / 2.0), 12) AS lam FROM w, (SELECT unnest(range(0, 99)) AS i) WHERE low + i / 2.0 <= high")
def lambda_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values a decade between the least and greatest lambda that a pair's records have."""
    spans = X.records(spark, sf_dir).groupBy("pairs").agg(F.min("log_lam").alias("low"), F.max("log_lam").alias("high")).collect()  # a row a pair
    axes = [(r.pairs, i, round(x, 12)) for r in spans for i, x in enumerate(experiment.lambda_grid(10.0**r.low, 10.0**r.high, 2))]
    return spark.createDataFrame(axes, "pairs int, place long, lam double")


@query(REG + """, w AS (SELECT family, max(latent_dim) AS top FROM registry GROUP BY family), c AS (SELECT unnest(['whiten', 'pca']) AS chart), k AS (SELECT unnest([4.0, 0.5, 8.0, 1.0]) AS request),
n AS (SELECT family, chart, top, CASE WHEN request <= 1 THEN CAST(round_even(request * top, 0) AS BIGINT) ELSE CAST(request AS BIGINT) END AS n FROM w, c, k)
SELECT DISTINCT family, chart, CASE WHEN n >= top THEN NULL ELSE n END AS symbols FROM n""")
def chart_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts by rate for the largest rank of each family of models."""
    tops = X.registry(spark, sf_dir).groupBy("family").agg(F.max("latent_dim").alias("top")).collect()  # a row a family
    return spark.createDataFrame([(r.family, *cell) for r in tops for cell in experiment.resolve_charts(["whiten", "pca"], [4, 0.5, 8, 1.0], r.top)], "family string, chart string, symbols long")


@query("WITH" + X.LATENT_SQL + ", o AS (SELECT sample_id, label, row_number() OVER (ORDER BY sample_id) - 1 AS row FROM a), w AS (SELECT unnest([7, 3, 3, 0, 120]) AS row, unnest(range(0, 5)) AS pos) SELECT CAST(pos AS INTEGER) AS pos, sample_id, label FROM w JOIN o ON w.row = o.row")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position, in the order asked for and as often."""
    return selection.at_positions(X.agent_a(spark, sf_dir).select("sample_id", "label"), [7, 3, 3, 0, 120])


@query(REG + " SELECT DISTINCT 'embeddings/latents-' || family AS repo, 'agent_' || lpad(CAST(latent_dim AS VARCHAR), 2, '0') AS agent FROM registry")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.registry(spark, sf_dir)
    return r.select(repo_id("family").alias("repo"), F.concat(F.lit("agent_"), F.lpad(F.col("latent_dim").cast("string"), 2, "0")).alias("agent")).distinct()
