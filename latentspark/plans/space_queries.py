"""Queries over embedding spaces: statistics, kernels, designs, scores and graphs."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.functions.kernels import Kernel, median_sq_dist
from latentspark.operators import balls, blocks, graphs, metrics, pairs, pilots, selection, spaces
from latentspark.plans.registry import query
from latentspark.sources import fixtures as X

L = "WITH" + X.LATENT_SQL
#: Median squared distance of the first 2,000 rows by hash, for SQL.
MED = """, s AS (SELECT sample_id, v FROM a ORDER BY md5('0:' || sample_id), sample_id LIMIT 2000),
med AS (SELECT median(list_distance(p.v, q.v) * list_distance(p.v, q.v)) AS m FROM s p JOIN s q ON p.sample_id < q.sample_id)"""
ANCHORS = ", anchors AS (SELECT sample_id, v, row_number() OVER (ORDER BY md5('3:' || sample_id), sample_id) - 1 AS place FROM (SELECT * FROM a ORDER BY md5('3:' || sample_id), sample_id LIMIT 10))"
ANCHOR_SEED, N_ANCHORS = 3, 10


def _out(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_by_hash(X.agent_a(spark, sf_dir), N_ANCHORS, ANCHOR_SEED)


def _kernel(spark: SparkSession, sf_dir: str, name: str = "rbf") -> Kernel:
    a = X.agent_a(spark, sf_dir)
    return Kernel(name).fitted(median_sq_dist(a) if name in ("rbf", "laplacian") else 1.0)


@query(L + " SELECT a.sample_id, a.split, a.label, b.geo_label, len(a.v) AS width_a, len(b.v) AS width_b, round(a.v[1], 6) AS first_a, round(b.v[1], 6) AS first_b FROM a JOIN b ON a.sample_id = b.sample_id")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = X.agent_a(spark, sf_dir), X.agent_b(spark, sf_dir)
    met = a.join(b.select("sample_id", F.col("v").alias("w"), "geo_label"), "sample_id")
    return met.select("sample_id", "split", "label", "geo_label", F.size("v").cast("long").alias("width_a"), F.size("w").cast("long").alias("width_b"), F.round(F.col("v")[0], 6).alias("first_a"), F.round(F.col("w")[0], 6).alias("first_b"))


LONG = ", f AS (SELECT sample_id, unnest(range(0, 8)) AS dim, unnest(v) AS x, sqrt(list_dot_product(v, v)) AS n FROM a), m AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM f GROUP BY dim)"


def _standardised(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    done = spaces.long_form(spaces.standardised(X.agent_a(spark, sf_dir), method))
    return _out(done.withColumn("dim", F.col("dim").cast("long")), "value")


@query(L + LONG + " SELECT sample_id, dim, round(x / n, 6) AS value FROM f")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardised(spark, sf_dir, "l2")


@query(L + LONG + " SELECT sample_id, f.dim, round(x - mean, 6) AS value FROM f JOIN m ON f.dim = m.dim")
def center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardised(spark, sf_dir, "center")


@query(L + LONG + " SELECT sample_id, f.dim, round((x - mean) / std, 6) AS value FROM f JOIN m ON f.dim = m.dim")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardised(spark, sf_dir, "standard")


@query(L + LONG + " SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS most FROM f GROUP BY dim")
def column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = spaces.column_stats(X.agent_a(spark, sf_dir)).withColumn("dim", F.col("dim").cast("long"))
    return _out(stats, "mean", "std", "least", "most")


FG = """, f AS (SELECT sample_id, unnest(range(0, 8)) AS i, unnest(v) AS x FROM a), g AS (SELECT sample_id, unnest(range(0, 12)) AS j, unnest(v) AS y FROM b)"""


@query(L + FG + " SELECT i, j, round(sum(x * y), 4) AS c FROM f JOIN g ON f.sample_id = g.sample_id GROUP BY i, j")
def cross_moment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = X.agent_a(spark, sf_dir).join(X.agent_b(spark, sf_dir).select("sample_id", F.col("v").alias("w")), "sample_id")
    cells = blocks.moments(both, "v", "w").where(f"i BETWEEN 1 AND {X.WIDTH_A} AND j > {X.WIDTH_A}")
    return cells.select((F.col("i") - 1).cast("long").alias("i"), (F.col("j") - X.WIDTH_A - 1).cast("long").alias("j"), F.round("s", 4).alias("c"))


@query(L + FG + ", h AS (SELECT sample_id, i AS j, x AS y FROM f) SELECT f.i, h.j, round(avg(x * y) - avg(x) * avg(y), 6) AS cov FROM f JOIN h ON f.sample_id = h.sample_id AND f.i <= h.j GROUP BY f.i, h.j")
def cov_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cov = spaces.covariance(blocks.moment_matrix(X.agent_a(spark, sf_dir), "v"))
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return _out(spark.createDataFrame(rows, "i long, j long, cov double"), "cov")


@query(L + FG + " SELECT i, j, round(corr(x, y), 6) AS r FROM f JOIN g ON f.sample_id = g.sample_id GROUP BY i, j")
def pearson_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = X.agent_a(spark, sf_dir).join(X.agent_b(spark, sf_dir).select("sample_id", F.col("v").alias("w")), "sample_id")
    _, cov = spaces.covariance(blocks.moment_matrix(both, "v", "w"))
    std = np.sqrt(np.diag(cov))
    std[std == 0] = 1.0
    rows = [(i, j, float(cov[i, X.WIDTH_A + j] / std[i] / std[X.WIDTH_A + j])) for i in range(X.WIDTH_A) for j in range(X.WIDTH_B)]
    return _out(spark.createDataFrame(rows, "i long, j long, r double"), "r")


@query(L + MED + " SELECT round(m, 6) AS median FROM med")
def sq_dist_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(median_sq_dist(X.agent_a(spark, sf_dir)), 6),)], "median double")


@query(L + ", f AS (SELECT unnest(range(0, 8)) AS dim, unnest(v) AS x FROM a), m AS (SELECT var_pop(x) AS s FROM f GROUP BY dim) SELECT round(1 / (2 * 10 * avg(s)), 9) AS gamma FROM m")
def rule_of_thumb_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = spaces.column_stats(X.agent_a(spark, sf_dir))
    return stats.agg(F.round(1 / (2 * 10 * F.avg(F.col("std") * F.col("std"))), 9).alias("gamma"))


def _gram_sql(expression: str) -> str:
    return L + MED + f" SELECT p.sample_id AS i, q.sample_id AS j, round({expression}, 5) AS k FROM a p JOIN a q ON p.sample_id <= q.sample_id, med"


def _gram(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return pairs.gram(a, None, _kernel(spark, sf_dir, name)).withColumn("k", vec.rounded(F.col("k"), 5))


@query(_gram_sql("exp(-list_distance(p.v, q.v) * list_distance(p.v, q.v) / m)"))
def rbf_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram(spark, sf_dir, "rbf")


@query(_gram_sql("exp(-list_distance(p.v, q.v) / sqrt(m))").replace("p.sample_id <= q.sample_id", "p.sample_id < q.sample_id"))
def laplacian_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram(spark, sf_dir, "laplacian").where("i < j")


@query(_gram_sql("pow(list_dot_product(p.v, q.v) + 1, 3)").replace(", 5) AS k", ", 3) + 0.0 AS k"))
def poly_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return pairs.gram(a, None, Kernel("polynomial")).withColumn("k", vec.rounded(F.col("k"), 3) + 0.0)


@query(_gram_sql("list_dot_product(p.v, q.v)"))
def linear_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram(spark, sf_dir, "linear")


@query(_gram_sql("list_cosine_similarity(p.v, q.v)"))
def cosine_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram(spark, sf_dir, "cosine")


KL = """, n AS (SELECT count(*) AS n FROM a), g AS (SELECT p.sample_id AS i, q.sample_id AS j, list_dot_product(p.v, q.v) AS k, list_dot_product(r.v, s.v) AS m
FROM a p JOIN b r ON p.sample_id = r.sample_id, a q JOIN b s ON q.sample_id = s.sample_id),
c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS kc, m - avg(m) OVER (PARTITION BY i) - avg(m) OVER (PARTITION BY j) + avg(m) OVER () AS mc FROM g)"""


@query(L + KL + " SELECT i, j, round(kc, 5) AS k FROM c WHERE i <= j")
def double_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred linear Gram: the cells of K less row and column means, which come from mean_kernel and go with the rows."""
    return pairs.centred_gram(X.agent_a(spark, sf_dir), Kernel("linear")).withColumn("k", vec.rounded(F.col("k"), 5))


def _hsic_cka(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    both = X.agent_a(spark, sf_dir).join(X.agent_b(spark, sf_dir).select("sample_id", F.col("v").alias("w")), "sample_id")
    return pairs.cka(both, Kernel("linear"), Kernel("linear"))


@query(L + KL + " SELECT round(sum(kc * mc) / ((SELECT n FROM n) - 1) / ((SELECT n FROM n) - 1), 5) AS hsic FROM c")
def hsic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(float(_hsic_cka(spark, sf_dir)[0]), 5),)], "hsic double")


@query(L + KL + " SELECT round(sum(kc * mc) / sqrt(sum(kc * kc) * sum(mc * mc)), 6) AS cka FROM c")
def cka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(float(_hsic_cka(spark, sf_dir)[1]), 6),)], "cka double")


def _features(spark: SparkSession, sf_dir: str, similarity: str) -> DataFrame:
    anchors = [r.v for r in _anchors(spark, sf_dir).orderBy("place").collect()]
    long = spaces.long_form(spaces.similarity_features(X.agent_a(spark, sf_dir), anchors, similarity))
    return _out(long.select("sample_id", F.col("dim").cast("long").alias("anchor"), "value"), "value")


def _features_sql(expression: str) -> str:
    return L + ANCHORS + f" SELECT a.sample_id, q.place AS anchor, round({expression}, 6) AS value FROM a, anchors q"


@query(_features_sql("list_cosine_similarity(a.v, q.v)"))
def relative_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "cosine")


@query(_features_sql("list_dot_product(a.v, q.v)"))
def relative_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "inner")


@query(_features_sql("1 - list_cosine_similarity(a.v, q.v)"))
def descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "descriptor")


@query(L + """, f AS (SELECT geo_label, unnest(range(0, 12)) AS d, unnest(v) AS x FROM b), w AS (SELECT d, geo_label, var_pop(x) * count(*) AS s FROM f GROUP BY ALL),
t AS (SELECT d, var_pop(x) * count(*) AS s FROM f GROUP BY d) SELECT round((SELECT sum(s) FROM t), 4) AS total, round((SELECT sum(s) FROM w), 4) AS within, round((SELECT sum(s) FROM t) - (SELECT sum(s) FROM w), 4) AS between""")
def class_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(spaces.class_spread(X.agent_b(spark, sf_dir), "geo_label"), "total", "within", "between", places=4)


@query(L + ", f AS (SELECT geo_label, unnest(range(0, 12)) AS dim, unnest(v) AS x FROM b) SELECT geo_label, dim, count(*) AS n, round(sum(x), 6) AS total FROM f GROUP BY ALL")
def probe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = spaces.long_form(X.agent_b(spark, sf_dir), "v", ["geo_label"])
    return _out(long.groupBy("geo_label", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


MU = MED + ", k AS (SELECT p.sample_id AS i, q.sample_id AS j, exp(-list_distance(p.v, q.v) * list_distance(p.v, q.v) / m) AS k FROM a p, a q, med), mu AS (SELECT i, avg(k) AS mu FROM k GROUP BY i)"


@query(L + MU + " SELECT i AS sample_id, round(mu, 6) AS mu FROM mu")
def herding_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return _out(pairs.mean_kernel(a, None, _kernel(spark, sf_dir)), "mu")


HERD = L + MU + """, p1 AS (SELECT i FROM mu ORDER BY mu {d}, i LIMIT 1),
p2 AS (SELECT mu.i FROM mu JOIN k ON k.i = mu.i AND k.j = (SELECT i FROM p1) WHERE mu.i <> (SELECT i FROM p1) ORDER BY mu - k.k {d}, mu.i LIMIT 1),
p3 AS (SELECT mu.i FROM mu JOIN k x ON x.i = mu.i AND x.j = (SELECT i FROM p1) JOIN k y ON y.i = mu.i AND y.j = (SELECT i FROM p2)
WHERE mu.i NOT IN (SELECT i FROM p1 UNION ALL SELECT i FROM p2) ORDER BY mu - (x.k + y.k) / 2 {d}, mu.i LIMIT 1)
SELECT 0 AS place, i AS sample_id FROM p1 UNION ALL SELECT 1, i FROM p2 UNION ALL SELECT 2, i FROM p3"""


def _picks(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ids)), "place int, sample_id long")


@query(HERD.format(d="DESC"))
def herding_first_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picks(spark, selection.herding(X.agent_a(spark, sf_dir), 3, _kernel(spark, sf_dir)))


@query(HERD.format(d="ASC"))
def anti_herding_first_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picks(spark, selection.herding(X.agent_a(spark, sf_dir), 3, _kernel(spark, sf_dir), sign=-1))


@query(L + """, p1 AS (SELECT sample_id AS i, v FROM a ORDER BY md5('0:' || sample_id), sample_id LIMIT 1),
p2 AS (SELECT a.sample_id AS i, a.v FROM a, p1 ORDER BY list_distance(a.v, p1.v) DESC, a.sample_id LIMIT 1),
p3 AS (SELECT a.sample_id AS i, a.v FROM a, p1, p2 ORDER BY least(list_distance(a.v, p1.v), list_distance(a.v, p2.v)) DESC, a.sample_id LIMIT 1),
p4 AS (SELECT a.sample_id AS i FROM a, p1, p2, p3 ORDER BY least(list_distance(a.v, p1.v), list_distance(a.v, p2.v), list_distance(a.v, p3.v)) DESC, a.sample_id LIMIT 1)
SELECT 0 AS place, i AS sample_id FROM p1 UNION ALL SELECT 1, i FROM p2 UNION ALL SELECT 2, i FROM p3 UNION ALL SELECT 3, i FROM p4""")
def fps_first_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return _picks(spark, selection.farthest_points(a, 4, selection.first_by_hash(a, 1).first().sample_id))


@query(L + ", s AS (SELECT unnest([0, 1, 2]) AS repeat), p AS (SELECT repeat, sample_id, row_number() OVER (PARTITION BY repeat ORDER BY md5((7 + 1000 * repeat) || ':' || sample_id), sample_id) AS place FROM a, s WHERE split = 'train') "
  "SELECT CAST(repeat AS INTEGER) AS repeat, sample_id, CAST(place - 1 AS INTEGER) AS place FROM p WHERE place <= 40")
def drawn_pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three repeats of a random design, each in a pool of its own."""
    train = blocks.cut_lineage(X.agent_a(spark, sf_dir).where("split = 'train'"))
    parts = [pilots.draw_pilots(train, 40, "random", k, 7, 120).withColumn("repeat", F.lit(k)) for k in range(3)]
    return functools.reduce(DataFrame.union, parts)


#: Picks of whole greedy paths: a design's budget rather than its first steps.
PATH = 64
#: Rows of a matrix over the pool as lists, by id.
SQUARE = """, ids AS (SELECT list(sample_id ORDER BY sample_id) AS ids FROM a), square AS (
  SELECT list(r ORDER BY i) AS k FROM (SELECT i, list(k ORDER BY j) AS r FROM k GROUP BY i)
)"""
HERD_PATH = "WITH RECURSIVE" + L.removeprefix("WITH") + MU + SQUARE + """, start AS (SELECT list(mu ORDER BY i) AS mu FROM mu), path(t, pick, picks, s) AS (
  SELECT 0, 0::BIGINT, []::BIGINT[], list_transform(mu, lambda m: 0::DOUBLE) FROM start
  UNION ALL SELECT t + 1, p, list_append(picks, p), list_transform(s, lambda x, i: x + k[i][p]) FROM (
    SELECT *, list_position(scores, list_max(scores)) AS p FROM (
      SELECT path.*, list_transform(mu, lambda m, i: CASE WHEN list_contains(picks, i) THEN -1e300 ELSE {sign} * (m - CASE WHEN t > 0 THEN s[i] / t ELSE 0 END) END) AS scores FROM path, start WHERE t < {n})), square
) SELECT CAST(t - 1 AS INTEGER) AS place, ids[pick] AS sample_id FROM path, ids WHERE t > 0"""


@query(HERD_PATH.format(sign=1, n=PATH))
def herding_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picks(spark, selection.herding(X.agent_a(spark, sf_dir), PATH, _kernel(spark, sf_dir)))


@query(HERD_PATH.format(sign=-1, n=PATH))
def anti_herding_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picks(spark, selection.herding(X.agent_a(spark, sf_dir), PATH, _kernel(spark, sf_dir), sign=-1))


FAR_PATH = "WITH RECURSIVE" + L.removeprefix("WITH") + ", k AS (SELECT p.sample_id AS i, q.sample_id AS j, list_distance(p.v, q.v) AS k FROM a p, a q)" + SQUARE + """, path(t, pick, s) AS (
  SELECT 1, CAST(list_position(ids, (SELECT sample_id FROM a ORDER BY md5('0:' || sample_id), sample_id LIMIT 1)) AS BIGINT), list_transform(ids, lambda x: 1e300::DOUBLE) FROM ids
  UNION ALL SELECT t + 1, CAST(list_position(near, list_max(near)) AS BIGINT), near FROM (SELECT t, list_transform(s, lambda x, i: least(x, k[i][pick])) AS near FROM path, square WHERE t < {n})
) SELECT CAST(t - 1 AS INTEGER) AS place, ids[pick] AS sample_id FROM path, ids"""


@query(FAR_PATH.format(n=PATH))
def fps_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return _picks(spark, selection.farthest_points(a, PATH, selection.first_by_hash(a, 1).first().sample_id))


@query(L + ", c AS (SELECT v FROM a ORDER BY md5('0:' || sample_id), sample_id LIMIT 1) SELECT sample_id, round(list_distance(a.v, c.v), 6) AS d FROM a, c ORDER BY list_distance(a.v, c.v), sample_id LIMIT 20")
def ball_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return _out(selection.ball(a, selection.first_by_hash(a, 1).first().v, 20).select("sample_id", "d"), "d")


@query(L + ", c AS (SELECT DISTINCT label FROM a), k AS (SELECT label FROM c ORDER BY md5('0:' || label) LIMIT 3) SELECT sample_id, label FROM a WHERE label IN (SELECT label FROM k) ORDER BY md5('0:' || sample_id), sample_id LIMIT 40")
def classes_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.classes_design(X.agent_a(spark, sf_dir), 3, 40).select("sample_id", "label")


@query(L + ", t AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || sample_id), sample_id) - 1 AS pass FROM a) SELECT sample_id, pass, md5(label || ':' || pass) AS class_key FROM t")
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(X.agent_a(spark, sf_dir)).select("sample_id", F.col("pass").cast("long").alias("pass"), "class_key")


MEANS = ", f AS (SELECT label, unnest(range(0, 8)) AS d, unnest(v) AS x FROM a), c0 AS (SELECT label, d, avg(x) AS m FROM f GROUP BY ALL), c AS (SELECT label, list(m ORDER BY d) AS v FROM c0 GROUP BY label)"


@query(L + MEANS + " SELECT label, d AS dim, round(m, 6) AS value FROM c0")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = spaces.mean_vectors(X.agent_a(spark, sf_dir), ["label"])
    return _out(spaces.long_form(means, "centroid", ["label"]).withColumn("dim", F.col("dim").cast("long")), "value")


@query(L + MEANS + ", p AS (SELECT a.label, sample_id, row_number() OVER (PARTITION BY a.label ORDER BY list_distance(a.v, c.v), sample_id) AS place FROM a JOIN c ON a.label = c.label) SELECT label, sample_id FROM p WHERE place = 1")
def stratified_medoid_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.medoids(X.agent_a(spark, sf_dir), "label")


VOR = ANCHORS + ", p AS (SELECT a.sample_id, q.sample_id AS anchor, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.v, q.v), q.sample_id) AS place FROM a, anchors q), vor AS (SELECT sample_id, anchor FROM p WHERE place = 1)"


@query(L + VOR + " SELECT * FROM vor")
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.voronoi(X.agent_a(spark, sf_dir), _anchors(spark, sf_dir))


@query(L + VOR + """, f AS (SELECT anchor, unnest(range(0, 8)) AS d, unnest(v) AS x FROM vor JOIN a ON vor.sample_id = a.sample_id), c0 AS (SELECT anchor, d, avg(x) AS m FROM f GROUP BY ALL), c AS (SELECT anchor, list(m ORDER BY d) AS v FROM c0 GROUP BY anchor),
q AS (SELECT vor.anchor, a.sample_id, row_number() OVER (PARTITION BY vor.anchor ORDER BY list_distance(a.v, c.v), a.sample_id) AS place FROM vor JOIN a ON vor.sample_id = a.sample_id JOIN c ON vor.anchor = c.anchor)
SELECT anchor, sample_id FROM q WHERE place = 1""")
def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return selection.medoids(a.join(selection.voronoi(a, _anchors(spark, sf_dir)), "sample_id"), "anchor")


@query(L + VOR + ", f AS (SELECT anchor, unnest(range(0, 12)) AS d, unnest(v) AS x FROM vor JOIN b ON vor.sample_id = b.sample_id) SELECT anchor, d AS dim, round(avg(x), 6) AS value FROM f GROUP BY anchor, d")
def injected_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = selection.injected_anchors(selection.voronoi(X.agent_a(spark, sf_dir), _anchors(spark, sf_dir)), X.agent_b(spark, sf_dir))
    return _out(spaces.long_form(means, "centroid", ["anchor"]).withColumn("dim", F.col("dim").cast("long")), "value")


@query(L + MU + ", s50 AS (SELECT sample_id FROM a ORDER BY md5('1:' || sample_id), sample_id LIMIT 50) SELECT round((SELECT avg(k) FROM k) - 2 * (SELECT avg(k) FROM k WHERE i IN (SELECT sample_id FROM s50)) + (SELECT avg(k) FROM k WHERE i IN (SELECT sample_id FROM s50) AND j IN (SELECT sample_id FROM s50)), 6) AS mmd2")
def mmd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    return _out(pairs.mmd2(a, selection.first_by_hash(a, 50, 1), _kernel(spark, sf_dir)), "mmd2")


@query(L + ", s AS (SELECT label FROM a ORDER BY md5('2:' || sample_id), sample_id LIMIT 12) SELECT round(CAST((SELECT count(DISTINCT label) FROM s) AS DOUBLE) / (SELECT count(DISTINCT label) FROM a), 6) AS coverage")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.agent_a(spark, sf_dir)
    counts = [df.agg(F.countDistinct("label").cast("double").alias("n")) for df in (selection.first_by_hash(a, 12, 2), a)]
    return counts[0].select(F.col("n").alias("m")).crossJoin(counts[1]).select(F.round(F.col("m") / F.col("n"), 6).alias("coverage"))  # one row each


@query(L + ", o AS (SELECT sample_id, row_number() OVER (ORDER BY md5('0:' || sample_id), sample_id) - 1 AS place FROM a) SELECT budget, sample_id FROM o, (SELECT unnest([16, 32, 64]) AS budget) WHERE place < budget")
def pilot_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every budget is a prefix of one selection."""
    budgets = F.explode(F.filter(F.array(*[F.lit(b) for b in (16, 32, 64)]), lambda b: F.col("place") < b))
    return selection.first_by_hash(X.agent_a(spark, sf_dir), 64).select(budgets.alias("budget"), "sample_id")


@query(L + ", s AS (SELECT sample_id FROM a ORDER BY md5('5:' || sample_id), sample_id LIMIT 100) SELECT 'A' AS agent, sample_id FROM s UNION ALL SELECT 'B', sample_id FROM s")
def aligned_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = X.agent_a(spark, sf_dir).select(F.lit("A").alias("agent"), "sample_id").union(X.agent_b(spark, sf_dir).select(F.lit("B"), "sample_id"))
    return selection.aligned_subsample(agents, 100, 5)


@query(L + """, c AS (SELECT DISTINCT label FROM a WHERE label IS NOT NULL), q AS (SELECT label, floor(100 * (0.6 * (CASE WHEN label IN (1, 2) THEN 1 ELSE 0 END) / 2 + 0.4 / (SELECT count(*) FROM c)) + 0.5) AS quota FROM c),
p AS (SELECT a.sample_id, a.label, quota, row_number() OVER (PARTITION BY a.label ORDER BY md5('0:' || sample_id), sample_id) AS place FROM a JOIN q ON a.label = q.label) SELECT sample_id, label FROM p WHERE place <= quota""")
def biased_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.biased_subsample(X.agent_a(spark, sf_dir), 100, [1, 2], 0.6).select("sample_id", "label")


#: A prediction that SQL can make as well: the source's vector, filled with zeros, on the held-out split.
TEST = """, t AS (SELECT sample_id, v, geo_label FROM b WHERE split = 'test'), p AS (SELECT sample_id, list_concat(v, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS v FROM a WHERE split = 'test'),
m AS (SELECT p.sample_id, p.v AS p, t.v AS t, geo_label FROM p JOIN t ON p.sample_id = t.sample_id)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = F.array(*[F.lit(0.0)] * (X.WIDTH_B - X.WIDTH_A))
    return X.agent_a(spark, sf_dir).where("split = 'test'").select("sample_id", F.concat("v", zeros).alias("v"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.agent_b(spark, sf_dir).where("split = 'test'").select("sample_id", "v", "geo_label")


@query(L + TEST + """, f AS (SELECT unnest(range(0, 12)) AS d, unnest(p) AS p, unnest(t) AS t FROM m), s AS (SELECT d, sum((p - t) * (p - t)) AS e, sum(t * t) AS q, var_pop(t) * count(*) AS c, count(*) AS n FROM f GROUP BY d)
SELECT round(sum(e) / sum(n), 6) AS mse, round(sum(e) / sum(q), 6) AS nmse, round(1 - sum(e) / sum(c), 6) AS r2, round((SELECT avg(list_cosine_similarity(p, t)) FROM m), 6) AS cosine FROM s""")
def recon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.reconstruction(metrics.paired(_predicted(spark, sf_dir), _targets(spark, sf_dir))), "mse", "nmse", "r2", "cosine")


RANKS = TEST + ", k AS (SELECT m.sample_id, 1 + count(*) FILTER (t.sample_id <> m.sample_id AND list_cosine_similarity(m.p, t.v) > list_cosine_similarity(m.p, m.t)) AS rank FROM m, t GROUP BY m.sample_id)"


@query(L + RANKS + " SELECT sample_id, rank FROM k")
def paired_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.paired_ranks(_predicted(spark, sf_dir), _targets(spark, sf_dir))


@query(L + RANKS + " SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS top1, round(avg(CAST(rank <= 5 AS INT)), 6) AS top5, round(avg(CAST(rank <= 10 AS INT)), 6) AS top10 FROM k")
def mrr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.retrieval(pairs.paired_ranks(_predicted(spark, sf_dir), _targets(spark, sf_dir))), "mrr", "top1", "top5", "top10")


@query(L + TEST + ", g AS (SELECT list_position(p[1:5], list_max(p[1:5])) - 1 = geo_label AS hit, list_position(t[1:5], list_max(t[1:5])) - 1 = geo_label AS own FROM m) SELECT round(avg(CAST(hit AS INT)), 6) AS accuracy, round(avg(CAST(own AS INT)), 6) AS oracle, round(avg(CAST(hit AS INT)) / avg(CAST(own AS INT)), 6) AS ratio FROM g")
def decoder_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).join(_targets(spark, sf_dir).select("sample_id", F.col("v").alias("t"), "geo_label"), "sample_id")
    own, hit = (metrics.first_argmax(F.slice(c, 1, X.CLASSES)) for c in ("t", "v"))
    return _out(metrics.accuracy(rows, hit, own, F.col("geo_label")), "accuracy", "oracle", "ratio")


@query(L + TEST + ", f AS (SELECT unnest(p) AS p, unnest(t) AS t FROM m) SELECT round(1 - sum((1.1 * p - t) * (1.1 * p - t)) / sum((p - t) * (p - t)), 6) AS residual_r2 FROM f")
def residual_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.paired(_predicted(spark, sf_dir), _targets(spark, sf_dir))
    rows = both.select(F.col("p").alias("rigid"), vec.scaled(F.col("p"), F.lit(1.1)).alias("full"), "t")
    return _out(metrics.residual_r2(rows), "residual_r2")


KNN = """, d AS (SELECT p.sample_id AS src, q.sample_id AS dst, list_distance(p.v, q.v) AS d FROM b p, b q WHERE p.sample_id <> q.sample_id),
n0 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM d), n AS (SELECT * FROM n0 WHERE place <= 5),
duo AS (SELECT src, dst, d FROM n UNION ALL SELECT dst, src, d FROM n), s AS (SELECT avg(d) AS s FROM n WHERE place = 5),
w AS (SELECT src, dst, max(exp(-d * d / (2 * s * s))) AS w FROM duo, s GROUP BY src, dst),
deg AS (SELECT src AS node, sum(w) AS degree FROM w GROUP BY src),
wd AS (SELECT w.*, x.degree AS dx, y.degree AS dy FROM w JOIN deg x ON w.src = x.node JOIN deg y ON w.dst = y.node)"""
K = 5


def _graph(spark: SparkSession, sf_dir: str, **how: bool) -> tuple[DataFrame, DataFrame]:
    b = X.agent_b(spark, sf_dir)
    return blocks.cut_lineage(graphs.knn_graph(b, K, **how)), b.select(F.col("sample_id").alias("node"))


@query(L + KNN + " SELECT src, dst, CAST(place AS INTEGER) AS place, round(d, 6) AS d FROM n")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.agent_b(spark, sf_dir)
    return _out(pairs.nearest(b, None, K), "d")


@query(L + KNN + " SELECT src, dst, CAST(place AS INTEGER) AS place, round(d, 6) AS d FROM n")
def knn_in_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by balls, pairs of which that can't hold neighbours are skipped."""
    return _out(balls.nearest_in_balls(X.agent_b(spark, sf_dir), None, K, centres=64).rows, "d")


@query(L + KNN + " SELECT src, dst, 1.0::DOUBLE AS w FROM duo GROUP BY src, dst HAVING count(*) = 2")
def mutual_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, mutual=True)[0]


@query(L + KNN + " SELECT src, dst, round(w, 6) AS w FROM w")
def weighted_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_graph(spark, sf_dir, weighted=True)[0], "w")


@query(L + KNN + " SELECT node, round(degree, 6) AS degree FROM deg")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(graphs.degrees(*_graph(spark, sf_dir, weighted=True)), "degree")


@query(L + KNN + " SELECT src, dst, round(-w / sqrt(dx * dy), 6) AS l FROM wd UNION ALL SELECT sample_id, sample_id, 1.0 FROM b")
def laplacian_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(graphs.laplacian(*_graph(spark, sf_dir, weighted=True)), "l")


@query(L + KNN + " SELECT src, dst, round(-w / dx, 6) AS l FROM wd UNION ALL SELECT sample_id, sample_id, 1.0 FROM b")
def laplacian_rw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(graphs.laplacian(*_graph(spark, sf_dir, weighted=True), "random_walk"), "l")


@query(L + KNN + " SELECT src, dst, round(w / pow(dx * dy, 0.5), 6) AS w FROM wd")
def alpha_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(graphs.alpha_renormalised(*_graph(spark, sf_dir, weighted=True), 0.5), "w")


@query(L + ", p AS (SELECT sample_id, list_concat(v, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS v FROM a), n AS (SELECT p.sample_id, b.sample_id AS match, row_number() OVER (PARTITION BY p.sample_id ORDER BY list_distance(p.v, b.v), b.sample_id) AS place FROM p, b) SELECT sample_id, match FROM n WHERE place = 1")
def stitch_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = F.array(*[F.lit(0.0)] * (X.WIDTH_B - X.WIDTH_A))
    a = X.agent_a(spark, sf_dir).select("sample_id", F.concat("v", zeros).alias("v"))
    return pairs.nearest(a, X.agent_b(spark, sf_dir), 1).select(F.col("src").alias("sample_id"), F.col("dst").alias("match"))


@query(L + " SELECT CAST(n AS BIGINT) AS budget, round(3.9 * pow(n / CAST((SELECT count(*) FROM a) AS DOUBLE), 0.7), 6) AS bandwidth FROM (SELECT unnest([16, 32, 64, 128]) AS n)")
def scheduled_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bandwidth of each pilot budget, given the pool."""
    pool = X.agent_a(spark, sf_dir).agg(F.count("*").alias("pool"))
    budgets = pool.select("pool", F.explode(F.array(*[F.lit(n).cast("long") for n in (16, 32, 64, 128)])).alias("budget"))
    return budgets.select("budget", F.round(selection.scheduled_bandwidth(F.col("budget"), F.col("pool")), 6).alias("bandwidth"))
