"""Queries of what must hold of charts, maps and spectra. What they say is asserted by tests; those with SQL return what SQL can compute from the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.functions.kernels import Kernel, median_sq_dist
from latentspark.operators import diagnostics, experiment, graphs, grids, pilots, scaling, spectral
from latentspark.operators.align.kernel import CKAAligner, KCCAAligner, RKHSAligner
from latentspark.operators.blocks import cut_lineage, map_vectors, moment_matrix
from latentspark.operators.pairs import mean_kernel
from latentspark.operators.spaces import covariance
from latentspark.plans import map_sql
from latentspark.plans.registry import query
from latentspark.sources import fixtures as X
from latentspark.sources.synthetic import synthetic_agents

A, B = X.WIDTH_A, X.WIDTH_B
#: Errors are shown to this many places.
PLACES = 6


def _identity(n: int) -> str:
    return f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(i = j AS DOUBLE) AS value FROM (SELECT unnest(range(0, {n})) AS i), (SELECT unnest(range(0, {n})) AS j)"


def _cells(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(m[i, j]), PLACES) + 0.0) for i in range(len(m)) for j in range(m.shape[1])], "i int, j int, value double")


def _values(rows: list[tuple], columns: str) -> str:
    shown = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(cut_lineage(f(spark, sf_dir).where("split = 'train'")) for f in (X.agent_a, X.agent_b))


def _greatest(m: np.ndarray) -> float:
    return round(float(np.abs(m).max()), PLACES) + 0.0


@query(map_sql.HELD_OUT_SQL)
def whitened_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of held-out rows on a chart whitened on the others."""
    b = X.agent_b(spark, sf_dir)
    chart = scaling.Scaler("whiten").fit(b.where("split = 'train'"))
    return _cells(spark, covariance(moment_matrix(chart.transform(b.where("split = 'test'").select("v")), "v"))[1])


@query()
def pca_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on principal axes don't correlate."""
    b = X.agent_b(spark, sf_dir)
    cov = covariance(moment_matrix(scaling.Scaler("pca").fit(b).transform(b.select("v")), "v"))[1]
    return _cells(spark, cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))


CHARTS = [("none", None), ("center", None), ("standard", None), ("pca", None), ("whiten", None), ("pga", None), ("whiten", 5), ("pca", 5)]


@query()
def chart_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chart its width, whether it can be undone, and the greatest error of undoing it on its own image."""
    b = cut_lineage(X.agent_b(spark, sf_dir).select("sample_id", "v"))
    rows = []
    for method, k in CHARTS:
        s = scaling.Scaler(method, k).fit(b)
        # A chart that loses rows' lengths or directions keeps what it shows.
        undone = map_vectors(b, lambda x, s=s: (lambda z: np.abs(z - s.apply(s.invert(z))).max(axis=1, keepdims=True))(s.apply(x)), "v", "apart")
        rows.append((method, k or 0, s.out_dim, s.is_invertible, round(undone.agg(F.max(F.col("apart")[0])).first()[0], PLACES) + 0.0))
    return spark.createDataFrame(rows, "method string, asked int, width int, invertible boolean, error double")


@query()
def procrustes_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rigid map keeps lengths: Q'Q."""
    m = experiment.build_aligner("procrustes").fit(*_train(spark, sf_dir))
    return _cells(spark, m.q.T @ m.q)


SELF = ("procrustes", "pca_procrustes", "linear", "affine", "l_ortho", "rkhs", "rkhs_free")


@query()
def self_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space is mapped to itself."""
    b = cut_lineage(X.agent_b(spark, sf_dir))
    return experiment.run_pair(spark, b, b, SELF).select("method", F.round("mse", 4).alias("mse"), F.round("mrr", PLACES).alias("mrr"))


@query()
def residual_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residual stage is orthogonal to the source, so that the rigid stage alone is the rigid map."""
    a, b = _train(spark, sf_dir)
    rows = []
    for method, chart in (("rkhs", "whiten"), ("pca_rkhs", "pca")):
        m = experiment.build_aligner(method).fit(a, b)
        g = m.residual_rows(m.x)
        rigid = experiment.build_aligner("procrustes", preprocess=chart).fit(a, b)
        apart = map_vectors(a.select("sample_id", "v"), lambda x, m=m, rigid=rigid: np.abs(m.apply_linear(x) - rigid.apply(x)).max(axis=1, keepdims=True), "v", "apart")
        overlap = float(np.abs(g.T @ m.x).max() / max(np.abs(g).max() * np.abs(m.x).max() * len(g), 1e-300))
        rows.append((method, round(overlap, 4) + 0.0, round(apart.agg(F.max(F.col("apart")[0])).first()[0], PLACES) + 0.0))
    return spark.createDataFrame(rows, "method string, overlap double, rigid double")


LAMBDAS = (1e-4, 1e-2, 1.0)


@query()
def lambda_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solving anew on one eigendecomposition gives the map of a new fit."""
    a, b = _train(spark, sf_dir)
    one, rows = RKHSAligner(lam=LAMBDAS[0]).fit(a, b), []
    for lam in LAMBDAS:
        again, anew = one.set_lam(lam), RKHSAligner(lam=lam).fit(a, b)
        apart = map_vectors(a.select("sample_id", "v"), lambda x: np.abs(again.apply(x) - anew.apply(x)).max(axis=1, keepdims=True), "v", "apart")
        rows.append((lam, round(apart.agg(F.max(F.col("apart")[0])).first()[0], PLACES) + 0.0))
    return spark.createDataFrame(rows, "lam double, error double")


CHANNELS = (("cka", CKAAligner, {"n_anchors": 40}, 40), ("cka_target", CKAAligner, {"n_anchors": 40, "readout": "target", "strategy": "random"}, 40), ("cka_match", CKAAligner, {"n_anchors": 24, "strategy": "random", "decode": "match"}, 24), ("kcca", KCCAAligner, {"n_canonical": 6}, 6))


@query()
def channel_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is received of what is sent is what the map gives; the width of what is sent is the map's rate."""
    a, b = _train(spark, sf_dir)
    test = cut_lineage(X.agent_a(spark, sf_dir).where("split = 'test'").select("sample_id", "v"))
    rows = []
    for name, kind, settings, _ in CHANNELS:
        m = kind(**settings).fit(a, b)
        sent = cut_lineage(m.transmit(test))
        got, whole = (np.array([r.v for r in df.orderBy("sample_id").collect()]) for df in (m.receive(sent), m.transform(test)))
        rows.append((name, len(sent.first().v), _greatest(got - whole)))
    return spark.createDataFrame(rows, "method string, width int, error double")


#: (name, preset, settings, pilots used if not all, symbols, parameters)
COSTS = (
    ("procrustes", "procrustes", {}, None, A, A * B), ("procrustes_3", "procrustes", {"n_components": 3}, None, 3, 9), ("linear", "linear", {}, None, A, A * B), ("affine", "affine", {}, None, A, A * B + B),
    ("cca_4", "cca", {"n_canonical": 4}, None, 4, 4 * (A + B)), ("relative_random", "relative", {"n_anchors": 20, "strategy": "random"}, 20, 20, 20 * (A + B)),
    ("relative_ridge", "relative", {"n_anchors": 20, "strategy": "random", "decode": "ridge"}, None, 20, 20 * (A + B)), ("rr", "rr", {"prune_threshold": None}, A, A, A * (A + B)),
    ("ppfe", "ppfe", {}, None, B, B * (A + B)), ("cka_random", "cka", {"n_anchors": 30, "strategy": "random"}, None, 30, 30 * (A + B)), ("cka_target", "cka", {"n_anchors": 30, "strategy": "random", "readout": "target"}, 30, 30, 30 * (A + B)),
)


@query("WITH n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 <> 0) SELECT name, CAST(coalesce(used, n) AS INTEGER) AS paired_used, symbols, map_params FROM n, (VALUES " + ", ".join(f"('{name}', {'NULL' if used is None else used}, {k}, {p})" for name, _, _, used, k, p in COSTS) + ") AS t(name, used, symbols, map_params)")
def map_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pilots that a map is made of, what it sends a row, and its size."""
    a, b = _train(spark, sf_dir)
    rows = []
    for name, preset, settings, *_ in COSTS:
        said = experiment.build_aligner(preset, **settings).fit(a, b).summary()
        rows.append((name, said["paired_used"], said["symbols"], said["map_params"]))
    return spark.createDataFrame(rows, "name string, paired_used int, symbols int, map_params int")


def _basis(spark: SparkSession, df: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    cells = cut_lineage(graphs.laplacian(graphs.knn_graph(df, 6, weighted=True), df.select(F.col("sample_id").alias("node"))))
    return (cells, *spectral.eigenvectors(cells, k))


@query()
def spectrum_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenpairs of the neighbour graph's Laplacian: L phi - lambda phi, phi'phi - I, and lambdas within 0 and 2 in order."""
    b = X.agent_b(spark, sf_dir)
    cells, nodes, values, phi = _basis(spark, b, 12)
    basis = spectral.basis_table(spark, nodes, phi).select(F.col("node").alias("dst"), "phi")
    parts = cells.join(basis, "dst").select("src", F.posexplode(F.transform("phi", lambda x: x * F.col("l"))).alias("dim", "x")).groupBy("src", "dim").agg(F.sum("x").alias("x"))
    own = basis.select(F.col("dst").alias("src"), F.posexplode("phi").alias("dim", "y"))
    lam = F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("dim"))
    worst = parts.join(own, ["src", "dim"]).agg(F.max(F.abs(F.col("x") - lam * F.col("y")))).first()[0]
    in_range = bool((np.diff(values) >= 0).all() and values[0] > -1e-9 and values[-1] < 2)
    return spark.createDataFrame([(len(nodes), 12, round(worst, 5) + 0.0, _greatest(phi.T @ phi - np.eye(12)), in_range)], "nodes long, k int, residual double, skew double, in_range boolean")


@query()
def functional_map_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of a space's basis to itself."""
    _, _, values, phi = _basis(spark, X.agent_b(spark, sf_dir), 12)
    f = np.random.default_rng(0).normal(size=(len(phi), 16))
    side = spectral.spectrum_of(values, phi, f)
    c = spectral.functional_map(side, side)
    return _cells(spark, np.round(c, 4))


@query()
def subspace_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An isometry's energy lies on the diagonal, a space has no angle with itself, and orthogonal ones have a right one."""
    b = X.agent_b(spark, sf_dir)
    axes = scaling.Scaler("pca").fit(b).forward
    turned = axes[:, :4] @ np.linalg.qr(np.random.default_rng(0).normal(size=(4, 4)))[0]
    return spark.createDataFrame([(round(spectral.map_similarity(axes), PLACES), round(float(spectral.principal_angle_cosines(axes[:, :4], turned).min()), PLACES), round(float(spectral.principal_angle_cosines(axes[:, :4], axes[:, 4:8]).max()), PLACES) + 0.0)], "similarity double, least_cosine double, apart double")


DESIGNS = ("random", "herding", "anti_herding", "fps", "round_robin", "ball", "kmeans", "classes:3")


@query()
def design_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each design fills its budget with distinct rows."""
    a = cut_lineage(X.agent_a(spark, sf_dir).where("split = 'train'"))
    kernel = Kernel().fitted(median_sq_dist(a))
    means = cut_lineage(mean_kernel(a, None, kernel))  # of all pairs, and so once for both herding designs
    rows = []
    for d in DESIGNS:
        n, ids = pilots.select_pilots(a, 9, d, kernel=kernel, means=means).agg(F.count("*"), F.count_distinct("sample_id")).first()
        rows.append((d, n, ids))
    return spark.createDataFrame(rows, "design string, pilots long, ids long")


@query()
def grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of pairs, methods and rates in two runs, the second of which finds half of it done."""
    agents = {"a": cut_lineage(X.agent_a(spark, sf_dir)), "b": cut_lineage(X.agent_b(spark, sf_dir).drop("geo_label"))}
    pairs = [("a", "b"), ("b", "a")]
    first, whole = (grids.rate_grid(pairs, methods, [4, None], 20, design="random", seeds=(1,)) for methods in (["procrustes"], ["procrustes", "linear"]))
    study = grids.Study(agents)
    out = grids.run_cells(spark, study, whole, grids.run_cells(spark, study, first))
    return out.select("source", "target", "method", "symbols", "n_pilots", "seed", "delivered", "paired_used", *(F.round(c, PLACES).alias(c) for c in ("nmse", "mrr", "top1")))


@query()
def lambda_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lambda axis by kernel width and budget, one fit for each width and budget, and the rigid map beside it."""
    agents = {"a": cut_lineage(X.agent_a(spark, sf_dir)), "b": cut_lineage(X.agent_b(spark, sf_dir).drop("geo_label"))}
    variants = grids.kernel_variants(["rbf"], [0.5, 2.0])
    out = grids.run_cells(spark, grids.Study(agents, variants=variants), grids.surface_grid([("a", "b")], list(variants), [20, 40], design="random"), lams=[1e-4, 1e-1])
    return out.select("variant", "lam", "n_pilots", *(F.round(c, PLACES).alias(c) for c in ("nmse", "mrr", "top1")))


@query()
def synthetic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and widths of made agents, as many rows of each split as the embeddings have."""
    splits = {r.split: r["count"] for r in X.agent_a(spark, sf_dir).groupBy("split").count().collect()}
    made = synthetic_agents(spark, 3, splits["train"], splits["test"])
    return made.groupBy("agent", "split").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"))


@query()
def kernel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel as a column and as a block of numbers are one."""
    a = cut_lineage(X.agent_a(spark, sf_dir).select("sample_id", "v"))
    first = np.array([a.orderBy("sample_id").first().v])
    rows = []
    for name in ("rbf", "laplacian", "polynomial", "linear", "cosine"):
        kernel = Kernel(name).fitted(3.0)
        value = kernel.column(F.col("v"), F.array(*[F.lit(float(v)) for v in first[0]]))
        both = map_vectors(a.withColumn("k", value), lambda x, kernel=kernel: kernel.block(x, first), "v", "other")
        apart, largest = both.agg(F.max(F.abs(F.col("k") - F.col("other")[0])), F.max(F.abs("k"))).first()
        rows.append((name, round(apart / largest, PLACES) + 0.0))
    return spark.createDataFrame(rows, "kernel string, error double")


@query(map_sql.CORRELATION_SQL)
def chart_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows that charts were fitted on and of held-out ones: distance from unit variance, and rms correlation."""
    a, b = cut_lineage(X.agent_a(spark, sf_dir)), cut_lineage(X.agent_b(spark, sf_dir))
    m = experiment.build_aligner("procrustes").fit(a.where("split = 'train'"), b.where("split = 'train'"))
    rows = []
    for split in ("train", "test"):
        said = diagnostics.chart_correlations(m, a.where(F.col("split") == split), b.where(F.col("split") == split))
        rows.append((split, *(round(said[c], PLACES) + 0.0 for c in ("src_off", "tgt_off", "rho_rms"))))
    return spark.createDataFrame(rows, "split string, src_off double, tgt_off double, rho_rms double")


@query()
def class_geometry_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space mapped to itself keeps its classes' geometry."""
    b = cut_lineage(X.agent_b(spark, sf_dir))
    m = experiment.build_aligner("procrustes").fit(b.where("split = 'train'"), b.where("split = 'train'"))
    test = b.where("split = 'test'")
    return diagnostics.class_geometry(m, test, test, "geo_label").select(*(F.round(c, 5).alias(c) for c in ("scale", "within", "between", "fisher", "nmse")))


@query()
def stationary_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the constraint the two stages are stationary: the residual stays orthogonal to the source and the rigid map where it was."""
    said = diagnostics.alternating_fit(*_train(spark, sf_dir), lam=1e-2, rounds=4, orthogonal=True)
    objective = [r["objective"] for r in said]
    falls = all(b <= a + 1e-9 for a, b in zip(objective, objective[1:], strict=False))
    return spark.createDataFrame([(falls, round(max(r["overlap"] for r in said), 4) + 0.0, round(max(r["moved"] for r in said), 3) + 0.0)], "falls boolean, overlap double, moved double")
