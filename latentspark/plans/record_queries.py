"""Queries over metric records and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import slugs as S
from latentspark.operators import records as R
from latentspark.plans.registry import query
from latentspark.operators import experiment
from latentspark.sources import fixtures as X

REC = "WITH" + X.RECORDS_SQL
REG = "WITH" + X.REGISTRY_SQL
JOINED = REG + ", j AS (SELECT c.model_name, cached, latent_dim, family, macro_family, num_parameters FROM configs c LEFT JOIN registry r ON c.model_name = r.model_name)"

def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.configs(spark, sf_dir).join(X.registry(spark, sf_dir), "model_name", "left")


@query(JOINED + " SELECT * FROM j")
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_join(spark, sf_dir)


@query(JOINED + " SELECT * FROM j WHERE regexp_matches(family, 'eco|promo', 'i') AND latent_dim >= 10 AND latent_dim <= 40 AND num_parameters <= 1500 AND cached")
def registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registry_filter(_registry_join(spark, sf_dir), family="eco|promo", min_dim=10, max_dim=40, max_params=1500, cached=True)


@query(JOINED + """ SELECT latent_dim, count(*) AS n_models, CAST(sum(CAST(cached AS INT)) AS BIGINT) AS n_cached,
  CAST(count(DISTINCT family) + max(CAST(family IS NULL AS INT)) AS BIGINT) AS n_families, coalesce(string_agg(DISTINCT family, ', ' ORDER BY family), '') AS families
  FROM j GROUP BY latent_dim""")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registry_summary(_registry_join(spark, sf_dir))


@query(JOINED + " SELECT model_name, latent_dim, family FROM j ORDER BY latent_dim DESC NULLS LAST, model_name LIMIT 20")
def registry_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry_join(spark, sf_dir).select("model_name", "latent_dim", "family").orderBy(F.desc_nulls_last("latent_dim"), "model_name").limit(20)


@query(REC + " SELECT method, log_lam, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM r GROUP BY method, log_lam")
def summarise_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.summarise(X.records(spark, sf_dir), ["method", "log_lam"], "score"), "mean", "std")


BEST = REC + """, s AS (SELECT method, n_pilots, log_lam, avg(score) AS mean FROM r GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(mean, 9) DESC, log_lam) AS place FROM s)
SELECT {cols}, log_lam, round(mean, 6) AS mean FROM p WHERE place = 1"""


def _lambda_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.records(spark, sf_dir).groupBy("method", "n_pilots", "log_lam").agg(F.avg("score").alias("mean"))


@query(REC + """, s AS (SELECT method, log_lam, avg(score) AS mean FROM r GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(mean, 9) DESC, log_lam) AS place FROM s)
SELECT method, log_lam, round(mean, 6) AS mean FROM p WHERE place = 1""")
def best_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = X.records(spark, sf_dir).groupBy("method", "log_lam").agg(F.avg("score").alias("mean"))
    return _round(R.best_rows(means, ["method"], F.round("mean", 9).desc(), F.col("log_lam")), "mean")


@query(BEST.format(by="method, n_pilots", cols="method, n_pilots"))
def lambda_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.best_rows(_lambda_means(spark, sf_dir), ["method", "n_pilots"], F.round("mean", 9).desc(), F.col("log_lam")), "mean")


@query(REC + """, s AS (SELECT n_pilots, log_lam, avg(score) AS mean FROM r GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY n_pilots ORDER BY round(mean, 9) DESC, log_lam) AS place FROM s),
sched AS (SELECT n_pilots, log_lam FROM p WHERE place = 1), w AS (SELECT CAST(unnest([100, 200, 300, 512, 1000, 20000]) AS BIGINT) AS n_pilots),
m AS (SELECT w.n_pilots, sched.n_pilots AS used, log_lam, row_number() OVER (PARTITION BY w.n_pilots ORDER BY abs(ln(sched.n_pilots) - ln(w.n_pilots)), sched.n_pilots) AS place FROM w, sched)
SELECT n_pilots, used, log_lam FROM m WHERE place = 1""")
def nearest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = X.records(spark, sf_dir).groupBy("n_pilots", "log_lam").agg(F.avg("score").alias("mean"))
    schedule = R.best_rows(means, ["n_pilots"], F.round("mean", 9).desc(), F.col("log_lam")).select("n_pilots", "log_lam")
    wanted = spark.createDataFrame([(n,) for n in (100, 200, 300, 512, 1000, 20000)], "n_pilots long")
    return R.nearest_in_log(wanted, schedule, "n_pilots").select("n_pilots", "used", "log_lam")


@query(REC + """, i AS (SELECT method, n_pilots, seed, avg(score) AS x FROM r WHERE score IS NOT NULL GROUP BY ALL)
SELECT method, n_pilots, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM i GROUP BY method, n_pilots""")
def two_level_pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.two_level(X.records(spark, sf_dir), ["method", "n_pilots"], ["seed"], "score"), "mean", "std")


@query(REC + """, i AS (SELECT method, seed, avg(score) AS x, max(n_pilots) AS cost FROM r GROUP BY ALL),
o AS (SELECT method, avg(x) AS mean, stddev_pop(x) AS std, max(cost) AS cost FROM i GROUP BY method)
SELECT method, round(mean, 6) AS mean, round(std, 6) AS std, cost, row_number() OVER (ORDER BY mean DESC, method) AS place FROM o""")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    out = R.two_level(r, ["method"], ["seed"], "score").drop("n").join(r.groupBy("method").agg(F.max("n_pilots").alias("cost")), "method")
    return _round(R.ranked(out, "mean", "method"), "mean", "std")


CELLS = ", c AS (SELECT method, pairs, seed, avg(score) AS x FROM r GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.records(spark, sf_dir).groupBy("method", "pairs", "seed").agg(F.avg("score").alias("x"))


@query(REC + CELLS + """, h AS (SELECT min(method) AS m FROM r), d AS (SELECT c.method, c.x - o.x AS delta FROM c JOIN c o ON c.pairs = o.pairs AND c.seed = o.seed, h
WHERE o.method = h.m AND c.method <> h.m)
SELECT method, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS std, CAST(sum(CAST(delta > 0 AS INT)) AS BIGINT) AS wins,
abs(avg(delta)) <= 2 * stddev_pop(delta) / sqrt(count(*)) AS tie FROM d GROUP BY method""")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    highlight = X.records(spark, sf_dir).agg(F.min("method")).first()[0]
    return _round(R.paired_deltas(_cells(spark, sf_dir), highlight, ["pairs", "seed"], "x"), "mean", "std")


T_SQL = "CASE WHEN {n} > 30 THEN " + " + ".join([repr(R.Z975), *(f"{c!r} / pow({{n}}, {k})" for k, c in enumerate(R.EXCESS, 1))]) + " ELSE (" + str(list(R.T975)) + ")[{n}] END"
CI = """ SELECT method, n_pilots, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
round(CASE WHEN count(x) < 2 THEN 0 ELSE (""" + T_SQL.format(n="(count(x) - 1)") + """) * stddev_samp(x) / sqrt(count(x)) END, 6) AS ci95 FROM i GROUP BY method, n_pilots"""


@query(REC + ", i AS (SELECT method, n_pilots, pairs, avg(score) AS x FROM r WHERE score IS NOT NULL GROUP BY ALL)" + CI)
def pair_average_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(R.mean_and_interval(X.records(spark, sf_dir), ["method", "n_pilots"], ["pairs"], "score"), "mean", "std", "ci95")


@query(REC + ", i AS (SELECT method, n_pilots, event_id % CAST(20 + n_pilots / 64 AS BIGINT) AS part, avg(score) AS x FROM r WHERE score IS NOT NULL GROUP BY ALL)" + CI)
def average_ci_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals over groups of 20 and more parts, on both sides of the quantile table's end."""
    r = X.records(spark, sf_dir).withColumn("part", F.col("event_id") % (20 + F.col("n_pilots") / 64).cast("long"))
    return _round(R.mean_and_interval(r, ["method", "n_pilots"], ["part"], "score"), "mean", "std", "ci95")


@query(REC + """, c AS (SELECT method, pairs, avg(score) AS x FROM r GROUP BY ALL), h AS (SELECT min(method) AS m FROM r),
o AS (SELECT c.pairs, c.x FROM c, h WHERE c.method = h.m), v AS (SELECT c.pairs, c.method, c.x, row_number() OVER (PARTITION BY c.pairs ORDER BY c.x DESC, c.method) AS place FROM c, h WHERE c.method <> h.m)
SELECT o.pairs, round(o.x - v.x, 6) AS margin, v.method AS rival FROM o JOIN v ON o.pairs = v.pairs WHERE place = 1""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    ours = r.agg(F.min("method")).first()[0]
    return _round(R.margins(r.groupBy("method", "pairs").agg(F.avg("score").alias("x")), ours, ["pairs"], "x"), "margin")


GRID = "m AS (SELECT DISTINCT method FROM r), s AS (SELECT DISTINCT strategy FROM r), k AS (SELECT DISTINCT n_pilots, log_lam FROM r)"


@query(REC + ", " + GRID + """ SELECT m.method, s.strategy, k.n_pilots, k.log_lam FROM m, s, k
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.method = m.method AND r.strategy = s.strategy AND r.n_pilots = k.n_pilots AND r.log_lam = k.log_lam)""")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    # The axes of a study grid, a few values each.
    grid = r.select("method").distinct().crossJoin(r.select("strategy").distinct()).crossJoin(r.select("n_pilots", "log_lam").distinct())
    return R.missing_cells(grid, r, ["method", "strategy", "n_pilots", "log_lam"])


@query(REC + """, old AS (SELECT method, pairs, avg(score) AS mean FROM r WHERE seed < 3 GROUP BY ALL),
fresh AS (SELECT method, pairs, avg(score) AS mean FROM r WHERE seed >= 3 AND method <> (SELECT min(method) FROM r) GROUP BY ALL)
SELECT method, pairs, round(mean, 6) AS mean FROM (SELECT * FROM old WHERE method NOT IN (SELECT method FROM fresh) UNION ALL SELECT * FROM fresh)""")
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    first = r.agg(F.min("method")).first()[0]
    old, fresh = (x.groupBy("method", "pairs").agg(F.avg("score").alias("mean")) for x in (r.where("seed < 3"), r.where((F.col("seed") >= 3) & (F.col("method") != first))))
    return _round(R.merge_summary(old, fresh), "mean")


PIVOT = REC + """, w AS (SELECT pairs, log_lam, avg(score) FILTER (strategy = 'herding') AS herding_score, avg(score) FILTER (strategy = 'random') AS random_score,
avg(score) FILTER (strategy = 'kmeans') AS kmeans_score FROM r GROUP BY pairs, log_lam)"""


@query(PIVOT + """ SELECT r.event_id, r.pairs, r.log_lam, round(r.score, 6) AS score, round(herding_score, 6) AS herding_score, round(random_score, 6) AS random_score
FROM r LEFT JOIN w ON r.pairs = w.pairs AND r.log_lam = w.log_lam""")
def baseline_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    baselines = r.select("pairs", "log_lam", F.col("strategy").alias("method"), "score")
    out = R.beside(r.select("event_id", "pairs", "log_lam", "score"), baselines, ["herding", "random"], ["pairs", "log_lam"], "score")
    return _round(out, "score", "herding_score", "random_score")


@query(PIVOT + """ SELECT pairs, log_lam, method, metric, round(value, 6) AS value FROM (
SELECT pairs, log_lam, 'herding' AS method, 'score' AS metric, herding_score AS value FROM w UNION ALL SELECT pairs, log_lam, 'random', 'score', random_score FROM w
UNION ALL SELECT pairs, log_lam, 'kmeans', 'score', kmeans_score FROM w)""")
def read_back_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = X.records(spark, sf_dir).groupBy("pairs", "log_lam").pivot("strategy", ["herding", "random", "kmeans"]).agg(F.avg("score"))
    wide = wide.select("pairs", "log_lam", *(F.col(m).alias(f"{m}_score") for m in ("herding", "random", "kmeans")))
    return _round(R.split_columns(wide, ["pairs", "log_lam"], ["herding", "random", "kmeans"], ["score"]), "value")


@query(REC + """, w AS (
  SELECT pairs, n_pilots, log_lam AS lam, avg(score) FILTER (strategy = 'herding') AS herding_score, avg(score) FILTER (strategy = 'random') AS random_score, avg(score) FILTER (strategy = 'kmeans') AS score_mean FROM r GROUP BY ALL
), best AS (SELECT * FROM w WHERE score_mean IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pairs, n_pilots ORDER BY score_mean DESC, lam) = 1)
SELECT pairs, n_pilots, lam, method, 'score' AS metric, round(CASE method WHEN 'herding' THEN herding_score WHEN 'random' THEN random_score ELSE score_mean END, 6) AS value FROM best, (SELECT unnest(['herding', 'random', 'kmeans']) AS method)""")
def read_back_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cell the lambda of the best mean score, with the scores of the swept method and of the others beside it."""
    r, of = X.records(spark, sf_dir), lambda m: F.avg(F.when(F.col("strategy") == m, F.col("score")))
    wide = r.groupBy("pairs", "n_pilots", F.col("log_lam").alias("lam")).agg(of("herding").alias("herding_score"), of("random").alias("random_score"), of("kmeans").alias("score_mean"))
    return _round(R.read_back(wide, ["pairs", "n_pilots"], ["herding", "random", "kmeans"], "kmeans", ["score"], "score", "lam"), "value")


@query(REC + " SELECT event_id, method, strategy FROM r WHERE strategy <> 'kmeans' AND NOT (method = (SELECT min(method) FROM r) AND strategy = 'random')".replace("strategy <> 'kmeans' AND ", ""))
def drop_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.records(spark, sf_dir)
    return R.drop_cells(r, [f"{r.agg(F.min('method')).first()[0]}:random"]).select("event_id", "method", "strategy")


MODEL_SLUG = r"regexp_replace(regexp_replace(replace(string_split({name}, '.')[1], 'patch', 'p'), '(_p[0-9]+)_[0-9]{{3}}$', '\1'), '[^A-Za-z0-9_+-]+', '-', 'g')"


@query(REG + " SELECT model_name, " + MODEL_SLUG.format(name="model_name") + """ AS model_slug,
concat_ws('_', regexp_replace(family, '[^A-Za-z0-9_+-]+', '-', 'g'), 'k' || CAST(latent_dim AS VARCHAR)) AS cell FROM registry""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.registry(spark, sf_dir).select("model_name", S.model_slug(F.col("model_name")).alias("model_slug"), S.joined(S.safe(F.col("family")), S.rate_slug(F.col("latent_dim"))).alias("cell"))


#: Names as encoders have them, made from the registry's rows.
ENCODERS = ", n AS (SELECT *, 'vit_small_patch' || latent_dim || '_' || CASE num_parameters % 3 WHEN 0 THEN '224' WHEN 1 THEN '16' ELSE '1024' END || '.' || family AS name FROM registry)"


@query(REG + ENCODERS + " SELECT name, " + MODEL_SLUG.format(name="name") + " AS slug FROM n")
def encoder_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("num_parameters") % 3
    size = F.when(k == 0, "224").when(k == 1, "16").otherwise("1024")
    name = F.concat(F.lit("vit_small_patch"), F.col("latent_dim").cast("string"), F.lit("_"), size, F.lit("."), F.col("family"))
    return X.registry(spark, sf_dir).select(name.alias("name")).withColumn("slug", S.model_slug(F.col("name")))


@query(REC + """, a AS (SELECT method, strategy, pairs, list(DISTINCT n_pilots ORDER BY n_pilots) AS n, list(DISTINCT log_lam ORDER BY log_lam) AS l FROM r GROUP BY ALL)
SELECT method, strategy, pairs, 'lambda_' || method || '_' || CAST(pairs AS VARCHAR) || 'pairs_whiten_kfull_n' || CAST(n[1] AS VARCHAR) || '_lam' || printf('%g', pow(2, l[1])) || 'to' || printf('%g', pow(2, l[-1])) || 'x' || CAST(len(l) AS VARCHAR) AS lambda_stem,
'pilots_' || method || '_' || CAST(pairs AS VARCHAR) || 'pairs_whiten_k8_N' || CAST(n[1] AS VARCHAR) || 'to' || CAST(n[-1] AS VARCHAR) || 'x' || CAST(len(n) AS VARCHAR) || '_' || strategy AS pilot_stem FROM a""".replace("printf('%g', pow(2, l[1]))", "replace(printf('%g', pow(2, l[1])), '.', 'p')").replace("printf('%g', pow(2, l[-1]))", "replace(printf('%g', pow(2, l[-1])), '.', 'p')"))
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of result files from the axes that records hold."""
    axes = X.records(spark, sf_dir).groupBy("method", "strategy", "pairs").agg(F.array_sort(F.collect_set("n_pilots")).alias("n"), F.array_sort(F.collect_set("log_lam")).alias("l"))
    pairs, chart = F.concat(F.col("pairs").cast("string"), F.lit("pairs")), S.chart_slug({"preprocess": "whiten"})
    grid = F.transform("l", lambda e: F.pow(F.lit(2.0), e))
    return axes.select(
        "method", "strategy", "pairs", S.lambda_stem(F.col("method"), pairs, chart, F.lit(None).cast("int"), F.get("n", F.lit(0)), grid).alias("lambda_stem"),
        S.pilot_stem(F.col("method"), pairs, chart, F.lit(8), F.col("n"), F.array("strategy")).alias("pilot_stem"),
    )


@query(REC + ", n AS (SELECT pairs, count(*) AS n FROM r GROUP BY pairs) SELECT round(0.5 / sqrt(min(n)), 9) AS noise_floor FROM n")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.records(spark, sf_dir).groupBy("pairs").count().agg(F.round(0.5 / F.sqrt(F.min("count")), 9).alias("noise_floor"))


@query(REG + """, m AS (SELECT DISTINCT latent_dim AS symbols FROM registry)
SELECT symbols, n_pilots FROM (SELECT DISTINCT symbols, CAST(ceil(rate * symbols) AS BIGINT) AS n_pilots FROM m, (SELECT unnest([0.5, 1, 2, 2.5, 8]) AS rate))""")
def budget_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pilot budgets of each rate for each rank."""
    ranks = [r.latent_dim for r in X.registry(spark, sf_dir).select("latent_dim").distinct().collect()]  # a row a rank
    return spark.createDataFrame([(k, n) for k in ranks for n in experiment.resolve_budgets(k, rates=(0.5, 1.0, 2.0, 2.5, 8.0))], "symbols int, n_pilots long")


@query(REG + """, q AS (SELECT model_name, latent_dim, unnest([0.25, 0.5, 1.0, 8.0, 30.0]::DOUBLE[]) AS request FROM registry),
k AS (SELECT *, CASE WHEN request <= 1 THEN greatest(1, CAST(round_even(request * latent_dim, 0) AS BIGINT)) ELSE CAST(request AS BIGINT) END AS n FROM q)
SELECT model_name, request, CASE WHEN n >= latent_dim THEN NULL ELSE n END AS symbols FROM k""")
def rank_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request is a count, or a share of the largest rank; one that reaches it asks for no compression (null)."""
    models = X.registry(spark, sf_dir).select("model_name", "latent_dim")
    ranks = [r.latent_dim for r in models.select("latent_dim").distinct().collect()]  # a row a rank
    asked = [(k, float(request), experiment.rank_request(request, k)) for k in ranks for request in (0.25, 0.5, 1.0, 8, 30)]
    return models.join(spark.createDataFrame(asked, "latent_dim int, request double, symbols long"), "latent_dim").drop("latent_dim")
