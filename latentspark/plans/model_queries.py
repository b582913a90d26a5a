"""Queries that fit maps, charts and spectral objects. Some have SQL through matrix iterations (map_sql), the others are held to invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.operators import experiment, graphs, pairs, scaling, selection, spaces, spectral
from latentspark.operators.align.kernel import CKAAligner
from latentspark.operators.decoders import MLPProbe, RidgeProbe
from latentspark.plans import map_sql
from latentspark.plans.registry import query
from latentspark.sources import fixtures as X

METRICS = ("mse", "nmse", "r2", "cosine", "mrr", "top1", "top5", "top10")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _register(name: str, preset: str, **over) -> None:
    """A preset's record on held-out rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(experiment.run_pair(spark, X.agent_a(spark, sf_dir), X.agent_b(spark, sf_dir), [preset], **over), *METRICS)

    run.__name__ = name
    query(map_sql.MAP_SQL.get(name))(run)


for _name, _preset, _over in (
    ("procrustes", "procrustes", {}), ("linear", "linear", {}), ("affine", "affine", {}), ("l_ortho", "l_ortho", {}),
    ("rkhs", "rkhs", {}), ("rkhs_free", "rkhs_free", {}), ("krr", "krr", {}), ("cca", "cca", {}), ("svcca", "svcca", {}), ("kcca", "kcca", {}),
    ("relative_map", "relative", {}), ("rr_map", "rr", {}), ("ppfe", "ppfe", {}), ("cka_map", "cka", {}),
    ("mlp_direct", "direct_mlp", {}), ("mlp_residual", "residual_mlp", {}), ("pca_procrustes", "pca_procrustes", {}), ("pga_procrustes", "pga_procrustes", {}),
):
    _register(_name, _preset, **_over)


def _register_wide(preset: str) -> None:
    """The same between agents of all 64 numbers of an embedding each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(experiment.run_pair(spark, X.wide_a(spark, sf_dir), X.wide_b(spark, sf_dir), [preset]), *METRICS)

    run.__name__ = f"wide_{preset}"
    query(map_sql.WIDE_MAP_SQL.get(run.__name__))(run)


for _preset in ("procrustes", "linear", "affine", "l_ortho", "pca_procrustes", "cca", "rkhs"):
    _register_wide(_preset)


@query()
def rkhs_lambda_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = experiment.lambda_grid(1e-6, 1e1, 1)
    return _round(experiment.lambda_sweep(spark, X.agent_a(spark, sf_dir), X.agent_b(spark, sf_dir), grid), *METRICS)


@query(map_sql.PILOT_SWEEP_SQL)
def pilot_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods x budgets x seeds with hash-ordered pilots."""
    a, b = X.agent_a(spark, sf_dir), X.agent_b(spark, sf_dir)
    return _round(experiment.run_grid(spark, a, b, ["procrustes", "linear"], [32, 64], selection.first_by_hash, (0, 1)), *METRICS)


def _cells(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(len(m)) for j in range(m.shape[1])], "i int, j int, value double")


@query(map_sql.WHITEN_SQL)
def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, scaling.Scaler("whiten").fit(X.agent_b(spark, sf_dir)).forward)


@query(map_sql.PCA_SQL)
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, scaling.Scaler("pca", 4).fit(X.agent_b(spark, sf_dir)).forward)


@query()
def pga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, scaling.Scaler("pga", 4).fit(X.agent_b(spark, sf_dir)).forward)


@query(map_sql.PROBE_SQL)
def ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.agent_b(spark, sf_dir)
    out = RidgeProbe().fit(b.where("split = 'train'"), "geo_label").classify(b.where("split = 'test'"))
    return out.select("sample_id", "geo_label", "predicted")


@query()
def mlp_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.agent_b(spark, sf_dir)
    out = MLPProbe().fit(b.where("split = 'train'"), "geo_label").classify(b.where("split = 'test'"))
    return out.select("sample_id", "geo_label", "predicted")


@query()
def cka_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows of both agents matched by local CKA, by an auction over blocks of all of them.

    price and profit add up to what no other matching can pass, which is the sum of scores.
    """
    a, b = X.agent_a(spark, sf_dir), X.agent_b(spark, sf_dir)
    aligner = CKAAligner(n_anchors=64).fit(a.where("split = 'train'"), b.where("split = 'train'"))
    matched = aligner.match_rows(a.where("split = 'test'"), b.where("split = 'test'"))
    return _round(matched, "score", "price", "profit")


def _basis(spark: SparkSession, df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = graphs.knn_graph(df, 6, weighted=True)
    return spectral.eigenvectors(graphs.laplacian(edges, df.select(F.col("sample_id").alias("node"))), k)


@query()
def hks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of all rows; beyond spectral.MAX_DENSE of them without a dense matrix."""
    b = X.agent_b(spark, sf_dir)
    nodes, values, vectors = _basis(spark, b, 20)
    return _round(spectral.heat_kernel_signature(spectral.basis_table(spark, nodes, vectors), values), "hks")


@query()
def functional_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the map between the two agents' bases over all shared rows; beyond spectral.MAX_DENSE of them without a dense matrix."""
    a = X.agent_a(spark, sf_dir)
    b = X.agent_b(spark, sf_dir).join(a.select("sample_id"), "sample_id", "left_semi")
    (nx, vx, px), (ny, vy, py) = _basis(spark, a, 12), _basis(spark, b, 12)
    anchors = selection.first_by_hash(a, 10, 3).select("sample_id")
    sides = []
    for df, values, vectors, nodes in ((a, vx, px, nx), (b, vy, py, ny)):
        rows = [r.v for r in df.join(anchors, "sample_id", "left_semi").orderBy("sample_id").collect()]  # ten anchors
        found = spaces.similarity_features(df.select("sample_id", "v"), rows, "descriptor")
        sides.append(spectral.distributed_spectrum(values, spectral.basis_table(spark, nodes, vectors), found))
    return _cells(spark, spectral.functional_map(*sides))


@query()
def stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences from a functional map: nearest rows of the mapped bases, all rows of them; beyond spectral.MAX_DENSE of them without a dense matrix."""
    a = X.agent_a(spark, sf_dir)
    b = X.agent_b(spark, sf_dir).join(a.select("sample_id"), "sample_id", "left_semi")
    (nodes_x, vx, px), (nodes_y, vy, py) = _basis(spark, a, 12), _basis(spark, b, 12)
    c = spectral.functional_map(spectral.spectrum_of(vx, px, px[:, :6]), spectral.spectrum_of(vy, py, py[:, :6]))
    right = spectral.basis_table(spark, nodes_y, py).select(F.col("node").alias("sample_id"), F.col("phi").alias("v"))
    return pairs.nearest(spectral.mapped_basis(spectral.basis_table(spark, nodes_x, px), c), right, 1).select(F.col("src").alias("sample_id"), F.col("dst").alias("match"))
