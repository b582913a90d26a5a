"""Sources, records, designs, graphs, runs and streams on small tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.functions import slugs
from latentspark.functions.kernels import Kernel, median_of, median_sq_dist
from latentspark.operators import blocks, decoders, diagnostics, experiment, graphs, grids, metrics, pairs, pilots, records, selection, spaces, spectral, stored, studies
from latentspark.operators.align.base import check_paired
from latentspark.operators.align.linear import ProcrustesAligner
from latentspark.operators.decoders import RidgeProbe
from latentspark.sources import tables
from latentspark.sources.space import LatentSpace
from latentspark.sources.synthetic import agent_name, synthetic_agents
from latentspark.streaming.maps import drift, map_stream


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, v array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).normal(size=(90, 5))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 20)
    monkeypatch.setattr(blocks, "LEAST", 5)
    monkeypatch.setattr(blocks, "STRIP", 7)


def test_moments_and_blocks(spark, points, small_blocks):
    df = frame(spark, points)
    m = blocks.moment_matrix(df, "v")
    x = np.column_stack([np.ones(90), points])
    assert np.allclose(m, x.T @ x)
    got = pairs.gram(df, df, Kernel("rbf", gamma=0.3)).toPandas()
    assert len(got) == 8100
    k = Kernel("rbf", gamma=0.3).block(points, points)
    assert np.allclose(got.k, k[got.i, got.j])
    mu = pairs.mean_kernel(df, df, Kernel("rbf", gamma=0.3)).toPandas().sort_values("sample_id").mu
    assert np.allclose(mu, k.mean(axis=1))
    with pytest.raises(ValueError):
        blocks.moment_matrix(df.where("false"), "v")


def test_kernels_as_columns_and_blocks(spark, points):
    df = frame(spark, points[:10])
    both = df.select("sample_id", "v").crossJoin(df.select(F.col("sample_id").alias("o"), F.col("v").alias("w")))
    for k in (Kernel("rbf", 0.2), Kernel("laplacian", 0.2), Kernel("polynomial"), Kernel("linear"), Kernel("cosine")):
        got = both.select("sample_id", "o", k.column(F.col("v"), F.col("w")).alias("k")).toPandas()
        assert np.allclose(got.k, k.block(points[:10], points[:10])[got.sample_id, got.o]), k
    for bad in ({"name": "none"}, {"name": "polynomial", "coef0": -1.0}):
        with pytest.raises(ValueError):
            Kernel(**bad)
    assert median_of(points[:1]) == median_of(np.zeros((3, 2))) == 1.0
    assert median_sq_dist(frame(spark, points)) == pytest.approx(median_of(points))


def test_ranks_and_neighbours_over_blocks(spark, points, small_blocks):
    noisy = points + np.random.default_rng(1).normal(size=points.shape)
    p, t = frame(spark, noisy), frame(spark, points)
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (noisy, points))
    s = u @ w.T
    expected = 1 + (s > np.diag(s)[:, None]).sum(axis=1)
    got = pairs.paired_ranks(p, t).toPandas().sort_values("sample_id")["rank"].to_numpy()
    assert (got == expected).all()
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = pairs.nearest(t, None, 4).toPandas().sort_values(["src", "place"])
    assert (near.dst.to_numpy().reshape(90, 4) == np.argsort(d, axis=1)[:, :4]).all()


def test_duplicate_points_are_neighbours_but_not_of_themselves(spark):
    df = frame(spark, np.zeros((4, 3)))
    assert {(r.src, r.dst) for r in pairs.nearest(df, None, 1).collect()} == {(0, 1), (1, 0), (2, 0), (3, 0)}


def test_cka_of_few_rows_and_no_spread(spark):
    df = frame(spark, np.ones((3, 2))).withColumn("w", F.col("v"))
    assert pairs.cka(df, Kernel("linear"), Kernel("linear")) == (pytest.approx(0), 0.0)
    assert pairs.cka(df.limit(1), Kernel("linear"), Kernel("linear")) == (0.0, 0.0)


def test_herding_beats_random_and_is_mirrored(spark, points):
    df, k = frame(spark, points), Kernel("rbf", gamma=0.2)
    picks = selection.herding(df, 10, k)
    assert picks[:4] == selection.herding(df, 4, k) and len(set(picks)) == 10
    gram = k.block(points, points)

    def mmd(some):
        return gram.mean() - 2 * gram[some].mean() + gram[np.ix_(some, some)].mean()

    assert mmd(picks) < np.mean([mmd(np.random.default_rng(s).choice(90, 10, replace=False)) for s in range(20)])
    assert selection.herding(df, 1, k, sign=-1) == [int(gram.mean(axis=1).argmin())]
    far = selection.farthest_points(df, 5, 7)
    assert far[0] == 7 and far[1] == int(((points - points[7]) ** 2).sum(axis=1).argmax())


def test_places_within_labels_come_by_prefix(spark):
    """One label with most rows and a null one: the same places as a window over the whole label, in many tasks."""
    rows = [(i, None if i % 97 == 0 else int(i % 10 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id long, label int")
    got = {r.sample_id: r.place for r in selection.ranked(df, "label", 5).collect()}
    ordered = sorted(rows, key=lambda r: (hashlib.md5(f"5:{r[0]}".encode()).hexdigest(), r[0]))
    seen: dict = {}
    for i, label in ordered:
        seen[label] = seen.get(label, 0) + 1
        assert got[i] == seen[label]
    few = {(r.sample_id, r.place) for r in selection.ranked(df, "label", 5, F.lit(7)).collect()}
    assert few == {(i, p) for i, p in got.items() if p <= 7}
    plan = selection.ranked(df, "label", 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label" not in plan or "_prefix" in plan


def test_ids_that_stand_often_on_one_side_are_not_paired(spark):
    left = spark.createDataFrame([(1, [1.0])] * 1001, "sample_id long, v array<double>")
    with pytest.raises(ValueError, match="not paired"):
        check_paired(left, left.where("false"))


def test_round_robin_prefixes_are_balanced(spark, points):
    labels = np.repeat([0, 1, 2], [60, 20, 10])
    order = selection.round_robin(frame(spark, points, labels)).orderBy("pass", "class_key").collect()
    assert [sum(r.label == x for r in order[:30]) for x in (0, 1, 2)] == [10, 10, 10]
    assert len(order) == 90


def test_draws(spark, points):
    df = frame(spark, points, np.arange(90) % 4)
    assert (selection.numpy_draw(50, 10, 3) == np.sort(np.random.default_rng(3).choice(50, 10, replace=False))).all()
    assert len(selection.numpy_draw(5, 9, 0)) == 5
    got = selection.at_positions(df, [4, 4, 0, 89]).orderBy("pos").collect()
    assert [r.sample_id for r in got] == [4, 4, 0, 89]
    with pytest.raises(IndexError):
        selection.at_positions(df, [90])
    ten, twenty = ({r.sample_id for r in selection.first_by_hash(df, n).collect()} for n in (10, 20))
    assert ten < twenty
    assert {r.label for r in selection.biased_subsample(df, 20, [1], 1.0).collect()} == {1}
    with pytest.raises(ValueError):
        selection.biased_subsample(df, 20, [9], 0.5)
    agents = df.select(F.lit("A").alias("agent"), "sample_id").union(df.limit(5).select(F.lit("B"), "sample_id"))
    with pytest.raises(ValueError):
        selection.aligned_subsample(agents, 3)


def test_graph_isolated_node_and_spectrum(spark, points):
    df = frame(spark, points)
    nodes = df.select(F.col("sample_id").alias("node")).union(spark.range(900, 901).toDF("node"))
    edges = graphs.knn_graph(df, 5, weighted=True)
    sym = graphs.laplacian(edges, nodes)
    assert sym.where("src = 900").collect()[0].l == 1.0
    ids, values, vectors = spectral.eigenvectors(sym.where("src <> 900"), 6)
    assert values[0] == pytest.approx(0, abs=1e-8) and (np.diff(values) >= -1e-12).all() and np.allclose(vectors.T @ vectors, np.eye(6))
    side = spectral.spectrum_of(values, vectors, vectors[:, :4])
    c = spectral.functional_map(side, side, 1e-2, 0)
    assert spectral.map_similarity(c) > 0.95
    basis = spectral.basis_table(spark, ids, vectors)
    assert spectral.heat_kernel_signature(basis, values, 3).count() == 270
    mutual = {(r.src, r.dst) for r in graphs.knn_graph(df, 5, mutual=True).collect()}
    assert mutual and all((b, a) in mutual for a, b in mutual)
    row_sums = graphs.laplacian(edges, nodes, "random_walk").where("src <> 900").groupBy("src").agg(F.sum("l").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in row_sums)
    with pytest.raises(ValueError):
        spectral.eigenvectors(sym, 500)


def test_two_level_mean_differs_from_one_level_and_skips_nulls(spark):
    rows = [("m", 0, 1.0), ("m", 0, 1.0), ("m", 0, 1.0), ("m", 1, 3.0), ("m", 1, None)]
    df = spark.createDataFrame(rows, "method string, seed int, score double")
    two, one = records.two_level(df, ["method"], ["seed"], "score").first(), records.summarise(df, ["method"], "score").first()
    assert (two["mean"], two.n, two["std"]) == (2.0, 2, 1.0) and one["mean"] == 1.5
    alone = records.mean_and_interval(df.where("seed = 0"), ["method"], ["seed"], "score").first()
    assert alone.ci95 == 0.0


def test_missing_cells_match_nulls(spark):
    grid = spark.createDataFrame([("a", None), ("a", 4), ("b", None)], "method string, symbols int")
    assert [(r.method, r.symbols) for r in records.missing_cells(grid, grid.limit(1), ["method", "symbols"]).orderBy("method").collect()] == [("a", 4), ("b", None)]


def test_merge_drop_and_margins(spark):
    df = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 1, 2.0), ("b", "x", 1, 5.0), ("c", "x", 1, 5.0), ("c", "x", 2, 5.0)], "method string, strategy string, pair int, score double")
    assert records.drop_cells(df, ["a:x", "c"]).count() == 2
    fresh = df.where("method = 'a'").withColumn("extra", F.lit(1))
    assert records.merge_summary(df, fresh).count() == 5
    got = records.margins(df, "a", ["pair"], "score").collect()
    assert [(r.pair, r.margin, r.rival) for r in got] == [(1, -3.0, "b")]


def test_record_files_keep_text_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([("001", 3, 0.5), ("2e3", None, None)], "name string, n long, x double")
    tables.write_records(df, str(tmp_path / "r"))
    schema = tables.records_schema(("name",), ("n",), ("x",))
    assert {tuple(r) for r in tables.read_records(spark, str(tmp_path / "r"), schema).collect()} == {("001", 3, 0.5), ("2e3", None, None)}
    assert tables.union_records(df, df.select("name").withColumn("other", F.lit(1))).columns == ["name", "n", "x", "other"]


def test_last_written_wins(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([("a", k)], "key string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    both = spark.read.parquet(str(tmp_path / "t")).select("*", "_metadata")
    assert tables.last_written(both, "key").count() == 1


def test_agents_table(spark, tmp_path):
    made = synthetic_agents(spark, 3, 40, 10, seed=1)
    assert sorted(map(str, made.collect())) == sorted(map(str, synthetic_agents(spark, 3, 40, 10, seed=1).repartition(7).collect()))
    widths = {r.agent: r.w for r in made.groupBy("agent").agg(F.max(F.size("v")).alias("w")).collect()}
    assert widths == {agent_name(0): 12, agent_name(1): 16, agent_name(2): 12}
    path = str(tmp_path / "agents")
    made.withColumnRenamed("agent", "model_name").withColumnRenamed("v", "embedding").write.partitionBy("model_name", "split").parquet(path)
    assert tables.available_models(spark, path).count() == 3
    assert tables.read_space(spark, path, "agent_01", "test").count() == 10
    assert tables.read_agents(spark, path, ["agent_00", "agent_02"]).count() == 100
    with pytest.raises(ValueError):
        tables.read_agents(spark, path, ["agent_09"])
    with pytest.raises(ValueError):
        tables.require_constant_width(made.withColumn("all", F.lit(1)), "v", "all")
    with pytest.raises(ValueError):
        synthetic_agents(spark, 1, 5, 5, ground_dim=20)


def test_slugs(spark):
    numbers = [0.25, -3.0, 0.0, 1e-8, 0.0001, 1e-5, 123456.0, 1234567.0, 1.5e300, 0.1 + 0.2, 100.0, 2 / 3]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").withColumn("s", slugs.real_slug(F.col("x"))).orderBy("i").collect()
    assert [r.s for r in rows] == [f"{x:g}".replace(".", "p") for x in numbers]
    names = {"vit base_p16_224.augreg": "vit-base_p16", "vit_small_patch16_224.x": "vit_small_p16", "regnety_016": "regnety_016", "a_p8_1024": "a_p8_1024"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", slugs.model_slug(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names
    pair = "array<struct<source:string,target:string>>"
    lists = [[("a.x", "b.y")], [("a", "b"), ("c", "b")], [("a", "b"), ("b", "a")]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, p {pair}").orderBy("i").select(slugs.pairs_slug(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == ["a-to-b", "2tx-to-b", "2pairs"]
    row = spark.range(1).select(
        slugs.lambda_stem(F.lit("data set"), F.lit("a-to-b"), slugs.chart_slug({"preprocess": "pca", "eps": 1e-6}), F.lit(None).cast("int"), F.lit(64), F.array(F.lit(1.0), F.lit(1e-6)), F.array(F.lit(0.5))).alias("lam"),
        slugs.pilot_stem(F.lit("d"), F.lit("p"), slugs.chart_slug({"name": "my.chart"}), F.lit(8), F.array(F.lit(4), F.lit(2)), F.array(F.lit("fps"), F.lit("classes:3"))).alias("pilots"),
        slugs.dimension_stem(F.lit("d"), F.lit("p"), F.lit("c"), F.lit(9), F.lit("fps"), F.array(F.lit(8), F.lit(4)), F.lit("mlp"), [1, 2]).alias("dims"),
        slugs.dimension_fits_stem(F.lit("d"), F.lit("p"), F.lit(9), F.lit("fps"), F.lit("mlp")).alias("fits"),
    ).first()
    assert row.lam == "lambda_data-set_a-to-b_pca-eps1e-06_kfull_n64_lam1e-06to1x2_bw0p5to0p5x1"
    assert row.pilots == "pilots_d_p_my-chart_k8_N2to4x2_fps-classes-3"
    assert (row.dims, row.fits) == ("dims_d_p_c_n9_fps_k4to8x2_dec-mlp_seeds1-2", "dimsfits_d_p_n9_fps_dec-mlp")
    assert slugs.result_dir("out/", "lam", "a b", "c.d") == "out/lam/a-b/c-d" and [slugs.value_slug(x) for x in (None, True, 0.5)] == ["none", "on", "0p5"]


@pytest.mark.parametrize("n", [2, 5, 12, 31, 32, 60, 400])
def test_interval_quantile(spark, n):
    """Against the JVM's own t distribution, beyond ten degrees of freedom too."""
    expected = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 1)).inverseCumulativeProbability(0.975)
    assert spark.range(1).select(records.t_quantile(F.lit(n - 1))).first()[0] == pytest.approx(expected, abs=1e-6)
    df = spark.createDataFrame([("m", i, float(i)) for i in range(n)], "method string, seed int, score double")
    row = records.mean_and_interval(df, ["method"], ["seed"], "score").first()
    assert row.ci95 == pytest.approx(expected * np.std(np.arange(n), ddof=1) / np.sqrt(n), rel=1e-6)


def test_records_that_are_not_whole(spark):
    grid = spark.createDataFrame([("a", None), ("a", 4)], "method string, symbols int")
    keys = ["method", "symbols"]
    assert records.require_whole_grid(grid, grid, keys).count() == 2
    for have in (grid.limit(1), grid.union(grid.limit(1))):
        with pytest.raises(ValueError):
            records.require_whole_grid(grid, have, keys)
    schedule = spark.createDataFrame([(100, 1.0), (1000, 2.0)], "n long, lam double")
    wanted = spark.createDataFrame([(100,), (400,)], "n long")
    assert {r.n: r.used for r in records.nearest_in_log(wanted, schedule, "n").collect()} == {100: 100, 400: 1000}
    with pytest.raises(KeyError):
        records.nearest_in_log(wanted, schedule, "n", nearest=False)
    assert records.nearest_in_log(wanted.limit(1), schedule, "n", nearest=False).first().lam == 1.0
    cells = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.51)], "method string, pair int, x double")
    assert [records.paired_deltas(cells, "a", ["pair"], "x", floor).first().tie for floor in (0.0, 0.1)] == [False, True]
    methods = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "m string, x double")
    assert {r.m: r.place for r in records.ranked(methods, "x", "m").collect()} == {"b": 1, "a": 2, "c": 3}


def test_pairs_ranks_and_budgets():
    e = experiment
    widths = {"a": 4, "b": 9, "c": 9}
    assert e.resolve_pairs(list(widths), widths=widths) == [("a", "b"), ("c", "b")]
    assert e.resolve_pairs(list(widths), pairs=[("c", "a")], max_pairs=1) == [("c", "a")]
    for bad in ([("a", "a")], [("a", "z")]):
        with pytest.raises(ValueError):
            e.resolve_pairs(list(widths), pairs=bad)
    assert [e.rank_request(r, 8) for r in (None, 3, 8, 20, 0.5, 1.0, 0.01)] == [None, 3, None, None, 4, None, 1]
    with pytest.raises(TypeError):
        e.rank_request(True, 8)
    assert e.resolve_budgets(8, rates=(0.5, 0.5, 1.1)) == [4, 9] and e.resolve_budgets(8, counts=[9, 3], rates=(1,)) == [3, 9]
    with pytest.raises(ValueError):
        e.check_budgets_fit_pool([10], 10)
    assert e.resolve_charts(["pca", "whiten"], [4, 0.5, None], 8) == [("pca", 4), ("pca", None), ("whiten", 4), ("whiten", None)]
    assert np.allclose(e.lambda_grid(1e-2, 1, 2), [0.01, 10**-1.5, 0.1, 10**-0.5, 1])
    assert e.spec_key({"a": 1, "b": 2}) == e.spec_key({"b": 2, "a": 1})


@pytest.mark.parametrize("preset", experiment.PRESETS)
def test_presets_build(preset):
    kind, _, rate_key, design = experiment.PRESETS[preset]
    assert isinstance(experiment.build_aligner(preset), kind) and design in pilots.STRATEGIES
    cut = experiment.configured(preset, {"name": "chart", "preprocess": "center"}, 5)
    assert (cut[rate_key], cut["preprocess"], "name" in cut, experiment.effective_rank(preset, cut)) == (5, "center", False, 5)
    assert experiment.effective_rank(preset, experiment.configured(preset)) is None
    over = experiment.configured(preset, {rate_key: 3}, 5)
    assert over[rate_key] == 3
    assert experiment.aligner_of(preset, {"preprocess": "center"}, 4).preprocess == "center"
    assert getattr(experiment.build_aligner(preset, 7), rate_key) == 7
    assert json.dumps(experiment.spec_key({"preset": preset}))


def test_presets_hold_their_own_settings():
    made = {p: experiment.build_aligner(p) for p in experiment.PRESETS}
    assert made["procrustes"].preprocess == made["rkhs"].preprocess == "whiten" and made["rkhs"].max_points == 24_000
    assert (len(made["rkhs"].lam_grid), len(made["pca_rkhs"].lam_grid), made["rkhs"].lam_grid[1]) == (17, 10, 3e-6)
    assert (made["cka_pca"].n_components, made["cka"].n_components, made["cka"].strategy) == (320, None, "kmeans")
    assert experiment.build_aligner("cka_pca", 7).n_components == 7
    assert (made["relative"].parseval, made["relative"].preprocess, made["ppfe"].preprocess, made["rr"].n_anchors) == (True, "standard", "standard", None)
    assert experiment.bandwidth_axis(None) is None and experiment.bandwidth_axis([2, 0.5]) == [0.5, 2.0]


def test_grid_of_cells(spark, tmp_path):
    made = synthetic_agents(spark, 2, 90, 30, n_classes=3)
    agents = {k: made.where(F.col("agent") == agent_name(i)).drop("agent") for i, k in enumerate("ab")}
    probes = {"b": RidgeProbe().fit(agents["b"].where("split = 'train'"))}
    pairs, variants = [("a", "b"), ("b", "a")], grids.kernel_variants(["rbf"], [0.5, 2.0])
    seen = []
    wanted = grids.method_grid(pairs, ["procrustes", "relative"], 40, 1)
    study = grids.Study(agents, {"turned": {"preprocess": "pca"}}, variants, probes, flush=lambda df: seen.append(df.count()))
    out = grids.run_cells(spark, study, wanted)
    assert out.count() == len(wanted) == 4 and sum(seen) == 4
    rows = out.collect()
    assert {r.design for r in rows if r.method == "relative"} == {"kmeans"} and {r.design for r in rows if r.method == "procrustes"} == {"herding"}
    assert all((r.accuracy is not None) == (r.target == "b") and r.coverage == 1.0 for r in rows)
    more = wanted + grids.rate_grid(pairs[:1], ["procrustes"], [2, None], 40, charts=["turned"], design="random")
    again = grids.run_cells(spark, study, more, out)
    new = [r for r in again.collect() if r.chart == "turned"]
    assert again.count() == 6 and sorted((r.symbols or 0, r.delivered) for r in new) == [(0, len(agents["a"].first().v)), (2, 2)]
    assert grids.averaged(again, ["method"]).count() == 2
    ablated = grids.run_cells(spark, study, grids.ablation_grid(pairs[:1], [30], "random") + grids.pilot_width_grid(pairs[:1], [2], 8))
    assert ablated.count() == 5 and grids.gains(ablated).count() == 3 and {r.design for r in ablated.collect()} == {"random", "herding@2"}
    designs = grids.run_cells(spark, study, grids.design_grid(pairs[:1], ["linear"], ["classes:1"], [10, 60]))
    assert {(r.design, r.n_pilots) for r in designs.collect()} == {("classes:1", 10)}
    assert set(grids.kernel_grid(pairs, variants, 30)) > set(grids.cells(pairs, ["procrustes"], budgets=[30], designs=["herding"]))
    with pytest.raises(ValueError):
        grids.run_cells(spark, study, grids.method_grid(pairs, ["linear"], 90, 1))
    surface = grids.surface_grid(pairs[:1], list(variants), [20], design="random")
    drawn = grids.run_cells(spark, study, surface, lams=[1e-4, 1e-2])
    points = [(r.variant, r.lam) for r in drawn.collect()]
    assert all((r.residual_r2 is not None) == (r.variant is not None) for r in drawn.collect())
    assert sorted(points, key=str) == sorted([(None, None), *((v, x) for v in variants for x in (1e-4, 1e-2))], key=str)
    best = {r.variant: r for r in grids.oracle_lambda(drawn, "mrr").collect()}
    assert set(best) == set(variants) and all(best[r.variant].mrr >= r.mrr for r in drawn.collect() if r.variant)
    wider = grids.run_cells(spark, study, surface[:1], done=drawn, lams=[1e-4, 1e-2, 1.0])
    assert sorted(r.lam for r in wider.where(F.col("variant") == surface[0].variant).collect()) == [1e-4, 1e-2, 1.0] and wider.count() == 6


def test_linear_reference_and_probe_join_a_record(spark):
    made = synthetic_agents(spark, 2, 60, 20, n_classes=2)
    a, b = (made.where(F.col("agent") == agent_name(k)) for k in (0, 1))
    probe = RidgeProbe().fit(b.where("split = 'train'"))
    rows = {r.method: r for r in experiment.run_pair(spark, a, b, ["procrustes", "rkhs"], probe=probe, linear_reference=True).collect()}
    assert rows["procrustes"].linear_ref_mrr is None and rows["rkhs"].linear_ref_mrr is not None
    assert all(0 <= r.accuracy <= 1 and r.oracle > 0.5 for r in rows.values())
    assert rows["rkhs"].linear_ref_top1 == pytest.approx(rows["procrustes"].top1)


def test_anchors_by_class_and_their_support(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "xy"[i % 2], [float(v) for v in rng.normal(size=2) * 0.1 + (i % 3) * 5 + (i % 2) * 40]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, label string, v array<double>")
    chosen = {r.sample_id for r in pilots.stratified(df, 6).collect()}
    assert {(i % 2, i % 3) for i in chosen} == {(a, b) for a in range(2) for b in range(3)}
    with pytest.warns(UserWarning):
        assert pilots.stratified(df, 200).count() < 200
    members = df.select("sample_id", F.when(F.col("sample_id") < 6, -1).otherwise(F.col("sample_id") % 3).alias("cluster"))
    assert pilots.support(members).count() == 54
    few = pilots.support(members, 4).collect()
    assert len(few) == 12 and {r.anchor for r in few} == {0, 1, 2}
    means = {r.anchor: r.centroid for r in pilots.prototypes(df, members, 4).collect()}
    for k, v in means.items():
        assert np.allclose(v, np.mean([rows[r.sample_id][2] for r in few if r.anchor == k], axis=0))


@pytest.mark.parametrize("block", [7, 20, 45, 500])
def test_each_two_blocks_meet_once(spark, points, monkeypatch, block):
    """Odd and even numbers of blocks, and a single one."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    df, kernel = frame(spark, points), Kernel("rbf", gamma=0.3)
    k = kernel.block(points, points)
    cells = pairs.gram(df, None, kernel).toPandas()
    assert len(cells) == len(cells.drop_duplicates(["i", "j"])) == 90 * 91 // 2 and (cells.i <= cells.j).all()
    assert np.allclose(cells.k, k[cells.i, cells.j])
    mu = pairs.mean_kernel(df, None, kernel).toPandas().sort_values("sample_id").mu
    assert np.allclose(mu, k.mean(axis=1))
    near = pairs.nearest(df, None, 3).toPandas()
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert len(near) == 270 and all(set(g.dst) == set(np.argsort(d[i])[:3]) for i, g in near.groupby("src"))


def test_checkpoints_need_a_shared_folder_off_local_mode(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda *_: None)})()})()

    with pytest.raises(RuntimeError):
        blocks.cut_lineage(Frame())


def test_usable_ranks(spark):
    df = spark.createDataFrame([("a", 4), ("b", 4), ("c", 9)], "agent string, w int")
    assert {r.target: (r.max_rank, r.n_pairs) for r in studies.usable_ranks(df, "agent", "w").collect()} == {"a": (4, 2), "b": (4, 2), "c": (4, 2)}
    assert {r.target: r.max_rank for r in studies.usable_ranks(df.where("agent <> 'b'"), "agent", "w").collect()} == {"a": 4, "c": 4}
    assert studies.usable_ranks(df.limit(1), "agent", "w").count() == 0


def test_sums_by_group(spark, points):
    labels = np.arange(90) % 4
    got = {r.key: (r.n, r.s) for r in blocks.column_sums(frame(spark, points, labels), "label").collect()}
    assert all(got[k][0] == (labels == k).sum() and np.allclose(got[k][1], points[labels == k].sum(axis=0)) for k in range(4))


def test_smallest_eigenvectors_without_a_dense_matrix(spark, points, monkeypatch):
    df = frame(spark, np.concatenate([points, points + 100]))  # two parts, so that 0 is a double eigenvalue
    edges = graphs.knn_graph(df, 6, weighted=True)
    cells = blocks.cut_lineage(graphs.laplacian(edges, df.select(F.col("sample_id").alias("node"))))
    nodes, values, vectors = spectral.eigenvectors(cells, 8)
    monkeypatch.setattr(spectral, "MAX_DENSE", 10)
    nodes_d, values_d, vectors_d = spectral.eigenvectors(cells, 8)
    assert (nodes == nodes_d).all() and np.allclose(values, values_d, atol=1e-8) and values_d[1] < 1e-8
    assert np.allclose(vectors_d.T @ vectors_d, np.eye(8), atol=1e-8)
    dense = np.zeros((180, 180))
    for r in cells.collect():
        dense[r.src, r.dst] = r.l
    assert np.abs(dense @ vectors_d - vectors_d * values_d).max() < 1e-6
    monkeypatch.setattr(spectral, "MAX_BASIS_BYTES", 1000)
    with pytest.raises(ValueError):
        spectral.eigenvectors(cells, 8)


def test_weights_of_zero_divide_nothing(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert all(r.w == 0 for r in graphs.alpha_renormalised(edges, nodes, 0.5).collect())
    assert {r.l for r in graphs.laplacian(edges, nodes).collect()} == {0.0, 1.0}


def test_finished_cells_are_not_run_again(spark):
    made = synthetic_agents(spark, 2, 60, 20)
    a, b = (made.where(F.col("agent") == agent_name(k)) for k in (0, 1))
    first = experiment.run_grid(spark, a, b, ["procrustes"], [30], selection.first_by_hash)
    again = experiment.run_grid(spark, a, b, ["procrustes", "linear"], [30], selection.first_by_hash, done=first)
    assert sorted(r.method for r in again.collect()) == ["linear", "procrustes"]
    assert first.first().top1 > 0.5


def test_metrics_of_a_perfect_and_an_unpaired_prediction(spark, points):
    df = frame(spark, points)
    row = metrics.alignment(df, df).first()
    assert (row.mse, row.r2, row.mrr, row.top1) == (0, 1, 1, 1) and row.cosine == pytest.approx(1)
    with pytest.raises(ValueError):
        metrics.paired(df, df.limit(5))


def test_a_map_on_a_stream_gives_the_rows_of_a_table(spark, points, tmp_path):
    src = frame(spark, points)
    aligner = ProcrustesAligner(preprocess="center").fit(src, frame(spark, points[:, ::-1]))
    src.withColumn("ts", (F.lit(1_700_000_000) + F.col("sample_id") * 60).cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id long, v array<double>, label int, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("mapped", map_stream(stream, aligner)), ("drifted", drift(stream, "ts", [0.0] * 5))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "mapped" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    got = {r.sample_id: r.v for r in spark.table("mapped").collect()}
    assert np.allclose([got[i] for i in range(90)], aligner.apply(points))
    assert sum(r.n for r in spark.table("drifted").collect()) == 90


@pytest.mark.parametrize("strategy", ["random", "herding", "anti_herding", "fps", "round_robin", "ball", "kmeans", "stratified", "classes:2"])
def test_designs_by_name(spark, points, strategy):
    df = frame(spark, points, np.arange(90) % 4)
    path = pilots.select_pilot_path(df, [4, 8], strategy).toPandas()
    small, large = ({*path[path.budget == b].sample_id} for b in (4, 8))
    assert len(large) == 8 or strategy == "stratified" and 4 <= len(large) <= 8
    if strategy in pilots.NESTED:
        assert small < large
    if strategy == "classes:2":
        assert len({i % 4 for i in large}) == 2
    assert pilots.select_pilots(df, 90, strategy).count() == 90


def test_design_names():
    assert pilots.parse_design("classes:3") == ("classes", 3)
    for bad in ("classes", "classes:0", "herding:2", "other"):
        with pytest.raises(ValueError):
            pilots.parse_design(bad)


def test_components_and_frames(spark, points):
    df = frame(spark, points)
    scores, values = spaces.components(df, 3)
    s = np.linalg.svd(points - points.mean(axis=0), compute_uv=False)[:3]
    assert np.allclose(values, s)
    z = np.array([r.v for r in scores.collect()])
    assert np.allclose(np.linalg.norm(z, axis=0), s)
    f = spaces.similarity_features(df, points[:9].tolist(), "inner", parseval=True)
    z = np.array([r.v for r in f.orderBy("sample_id").collect()])
    assert np.allclose(np.linalg.norm(z, axis=1), np.linalg.norm(points, axis=1))


def test_stored_models(spark, points, tmp_path):
    fitted = ProcrustesAligner(preprocess="center").fit(frame(spark, points), frame(spark, points[:, ::-1]))
    path = stored.model_path(str(tmp_path), "made", "procrustes", {"seed": 1})
    stored.save_model(spark, fitted, path)
    assert np.allclose(stored.load_model(spark, path, ProcrustesAligner).apply(points), fitted.apply(points))
    with pytest.raises(TypeError):
        stored.load_model(spark, path, dict)


def test_agents_by_source(spark, tmp_path):
    made = tables.load_agents(spark, "synthetic", ["agent_01"], n_agents=2, n_train=10, n_test=5)
    assert {r.agent for r in made.collect()} == {"agent_01"}
    made.withColumnRenamed("agent", "model_name").write.partitionBy("model_name", "split").parquet(str(tmp_path / "a"))
    assert tables.load_agents(spark, "table", ["agent_01"], path=str(tmp_path / "a")).count() == 15
    assert tables.is_cached(spark, str(tmp_path / "a"), "agent_01", "test") and not tables.is_cached(spark, str(tmp_path / "a"), "agent_02", "test")
    for source, models in (("other", None), ("synthetic", ["agent_77"])):
        with pytest.raises(ValueError):
            tables.load_agents(spark, source, models, n_agents=2, n_train=10, n_test=5)


def test_package_is_sent_where_workers_lack_it(spark, monkeypatch):
    from latentspark.plans import shipping

    before = list(spark.sparkContext._python_includes)
    shipping.ensure_importable(spark)  # the test session has PYTHONPATH
    assert spark.sparkContext._python_includes == before
    monkeypatch.setenv("PYTHONPATH", "")
    shipping.ensure_importable(spark)
    shipping.ensure_importable(spark)
    assert [x for x in spark.sparkContext._python_includes if x not in before] == ["latentspark.zip"]


def test_biased_draw_counts_classes_of_a_generator(spark):
    df = spark.createDataFrame([(i, i % 4, [float(i)]) for i in range(400)], "sample_id long, label int, v array<double>")
    got = {r.label: r["count"] for r in selection.biased_subsample(df, 60, [1], 0.5, 3, "multinomial").groupBy("label").count().collect()}
    expected = np.bincount(np.random.default_rng(3).choice(4, 60, p=[0.125, 0.625, 0.125, 0.125]), minlength=4)
    assert got == dict(enumerate(expected.tolist()))
    with pytest.warns(UserWarning):
        assert selection.biased_subsample(df.where("sample_id < 40"), 60, [1], 1.0, 3).count() == 10
    with pytest.raises(ValueError):
        selection.biased_subsample(df, 60, [9], 0.5)


def test_spaces_from_a_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, [float(i), 1.0], i % 3, m, s) for m in ("m1", "m2") for s, n in (("train", 30), ("test", 10)) for i in range(n)]
    spark.createDataFrame(rows, "sample_id long, embedding array<float>, label int, model_name string, split string").write.partitionBy("model_name", "split").parquet(path)
    space = LatentSpace.read(spark, path, "m1", "train")
    assert (space.n_points, space.dim, space.name) == (30, 2, "m1")
    assert [r.sample_id for r in space.select([4, 4, 0]).rows.orderBy("pos").collect()] == [4, 4, 0]
    assert space.subsample(7).n_points == 7 and space.biased_subsample(9, [1], 1.0).rows.select("label").distinct().collect() == [(1,)]
    assert space.biased_subsample(99, [1], 1.0).n_points == 30 and space.biased_subsample(5, [], 1.0).n_points == 5
    assert np.allclose(np.mean([r.v[0] for r in space.normalize("center").rows.collect()]), 0)
    with pytest.raises(ValueError):
        LatentSpace(space.rows.drop("label")).biased_subsample(5, [1], 1.0)
    assert [r.sample_id for r in tables.read_space(spark, path, "m2", "test", ordered_by="sample_id").collect()] == list(range(10))
    both = tables.read_agents(spark, path, ["m1", "m2"], sizes={"train": 6, "test": 4})
    ids = {(a, s): {r.sample_id for r in both.where(F.col("agent") == a).where(F.col("split") == s).collect()} for a in ("m1", "m2") for s in ("train", "test")}
    assert ids["m1", "train"] == ids["m2", "train"] and (len(ids["m1", "train"]), len(ids["m2", "test"])) == (6, 4)


def test_registry_reader(spark, tmp_path):
    rows = spark.createDataFrame([("a", 8, "f", "m", 10), ("b", 9, "f", "m", 20)], "model_name string, latent_dim int, family string, macro_family string, num_parameters long")
    rows.write.parquet(str(tmp_path / "r"))
    rows.write.option("header", True).csv(str(tmp_path / "r.csv"))
    assert tables.read_registry(spark, str(tmp_path / "r")).count() == tables.read_registry(spark, str(tmp_path / "r.csv")).count() == 2
    rows.drop("family").write.parquet(str(tmp_path / "less"))
    rows.union(rows.limit(1)).write.parquet(str(tmp_path / "twice"))
    for bad in ("less", "twice"):
        with pytest.raises(ValueError):
            tables.read_registry(spark, str(tmp_path / bad))


def test_guards_of_studies_and_probes(spark, points):
    records_ = spark.createDataFrame([("m", 1, 4, "ridge"), ("m", 1, 8, "ridge"), ("k", 1, 4, "mlp")], "method string, pair int, k int, decoder string")
    assert studies.require_complete(records_.where("method = 'm'"), ["pair", "k"], "method", "decoder").count() == 2
    for bad, axes in ((records_, ["pair", "k"]), (records_.where("k = 4"), ["pair"])):
        with pytest.raises(ValueError):
            studies.require_complete(bad, axes, "method", "decoder")
    with pytest.raises(ValueError):
        records.split_columns(records_, ["pair"], ["m"], ["score"])
    df = frame(spark, points, np.arange(90) % 2)
    assert isinstance(decoders.build_probe("ridge", df), RidgeProbe)
    for bad in (("tree", df), ("ridge", df.union(spark.createDataFrame([(999, [1.0], 0)], df.schema)))):
        with pytest.raises(ValueError):
            decoders.build_probe(*bad)


def test_diagnostics(spark):
    made = synthetic_agents(spark, 2, 120, 60, n_classes=3)
    a, b = (blocks.cut_lineage(made.where(F.col("agent") == agent_name(k)).drop("agent")) for k in (0, 1))
    (src, test), (tgt, own) = ((df.where("split = 'train'"), df.where("split = 'test'")) for df in (a, b))
    rigid, least = (experiment.build_aligner(p).fit(src, tgt) for p in ("procrustes", "linear"))
    wide, narrow = (diagnostics.class_geometry(m, test, own).first() for m in (rigid, least))
    assert narrow.scale < wide.scale and narrow.nmse < wide.nmse and rigid.r2 < 1
    y, p = (rigid.tgt.apply(np.array([r.v for r in df.orderBy("sample_id").collect()])) for df in (tgt, rigid.transform(src.select("sample_id", "v"))))
    assert rigid.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / (y**2).sum(), abs=1e-6)
    said = diagnostics.chart_correlations(rigid, src, tgt)
    assert said["src_off"] < 1e-6 and 0 <= said["rho_min"] <= said["rho_rms"] <= said["rho_max"] <= 1 + 1e-9
    free = diagnostics.alternating_fit(src, tgt, 1e-3, 3, False)
    held = diagnostics.alternating_fit(src, tgt, 1e-3, 3, True)
    assert free[0]["overlap"] > 100 * held[0]["overlap"] and held[2]["moved"] < free[2]["moved"]
    pilots_ = src.select("sample_id").orderBy("sample_id").limit(60)
    out = diagnostics.screen(spark, {"a": a, "b": b}, [("a", "b"), ("b", "a")], {"a": pilots_, "b": pilots_}, [1e-3, 1.0], extremes=1).collect()
    assert [r.place for r in out] == [0, 1] and out[0].rho <= out[1].rho and all(r.top1_gain is not None for r in out)


def dense_map(x, y, alpha, beta):
    """The stacked least-squares problem as one matrix of k^2 columns."""
    kx, ky = len(x.values), len(y.values)
    eye_x, eye_y = np.eye(kx), np.eye(ky)
    blocks = [np.kron(eye_y, x.coefficients.T), np.sqrt(alpha) * (np.kron(np.diag(y.values), eye_x) - np.kron(eye_y, np.diag(x.values)))]
    blocks += [np.sqrt(beta) * (np.kron(sy, eye_x) - np.kron(eye_y, sx.T)) for sx, sy in zip(x.products, y.products, strict=True)] if beta else []
    right = np.concatenate([y.coefficients.ravel(), np.zeros(sum(len(m) for m in blocks[1:]))])
    return np.linalg.lstsq(np.concatenate(blocks), right, rcond=None)[0].reshape(ky, kx)


def made_sides(n, kx, ky, q, seed=0):
    rng = np.random.default_rng(seed)
    phi_x, phi_y = np.linalg.qr(rng.normal(size=(n, kx)))[0], np.linalg.qr(rng.normal(size=(n, ky)))[0]
    return [(np.sort(rng.random(phi.shape[1])), phi, rng.normal(size=(n, q))) for phi in (phi_x, phi_y)]


@pytest.mark.parametrize("beta", [0.0, 1e-2])
def test_functional_maps_are_those_of_the_dense_problem(spark, beta):
    (vx, px, fx), (vy, py, fy) = made_sides(60, 12, 10, 6)
    x, y = spectral.spectrum_of(vx, px, fx), spectral.spectrum_of(vy, py, fy)
    assert np.allclose(spectral.functional_map(x, y, 1e-2, beta), dense_map(x, y, 1e-2, beta), atol=1e-6)
    descriptors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(fx)], "sample_id long, v array<double>").repartition(3)
    table = spectral.distributed_spectrum(vx, spectral.basis_table(spark, np.arange(60), px), descriptors)
    assert np.allclose(table.coefficients, x.coefficients) and np.allclose(table.products, x.products)


def test_functional_map_of_a_hundred_by_a_hundred():
    """Its normal equations would be a matrix of 10,000 by 10,000."""
    (vx, px, fx), (vy, py, fy) = made_sides(300, 100, 100, 8, 1)
    x, y = spectral.spectrum_of(vx, px, fx), spectral.spectrum_of(vy, py, fy)
    c = spectral.functional_map(x, y, 1e-2, 1e-2)
    slope = (c @ x.coefficients - y.coefficients) @ x.coefficients.T + 1e-2 * (vy[:, None] - vx[None]) ** 2 * c
    for sx, sy in zip(x.products, y.products, strict=True):
        e = sy @ c - c @ sx
        slope = slope + 1e-2 * (sy @ e - e @ sx)
    assert np.abs(slope).max() < 1e-7


def test_pairs_of_full_blocks_are_met_in_bounded_memory(monkeypatch):
    """Cells of a pair of the largest blocks are made a strip at a time, in memory that is a small part of all of them."""
    import tracemalloc

    found = {}
    monkeypatch.setattr(pairs, "pack_blocks", lambda *a, **k: None)
    monkeypatch.setattr(pairs, "for_block_pairs", lambda left, right, work, schema: found.update(work=work) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pairs.nearest(None, None, 4)
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(2, 8192, 3)), 1)  # ties
    a, b = (blocks.Block((np.arange(8192) * 2 + k).tobytes(), 8192, v[k].tobytes(), b"") for k in range(2))
    tracemalloc.start()
    parts = list(found["work"](a, b, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160_000_000  # all cells are 537 MB; strips of 1,024 rows took 224
    back = {c: np.concatenate([p[c] for p in parts]) for c in ("src", "dst")}
    some = back["src"] % 2 == 1
    near = {}
    for src, dst in zip(back["src"][some].tolist(), back["dst"][some].tolist(), strict=True):
        near.setdefault(src, set()).add(dst)
    for j in (0, 1, 4000, 8191):
        d = np.sqrt(pairs.sq_dists(v[0], v[1][[j]]))[:, 0]
        order = np.lexsort((a.ids, np.round(d, 9)))[:4]
        assert near[int(b.ids[j])] == set(a.ids[order].tolist()) or np.isclose(np.sort(d)[3], np.sort(d)[4])


def test_centred_cells_are_not_shuffled(spark):
    """means go with the rows of a block, so that nothing above the pairs of blocks moves a cell."""
    x = np.random.default_rng(5).normal(size=(300, 4))
    out = pairs.centred_gram(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id long, v array<double>"), Kernel("linear"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]
    cells = out.toPandas()
    y = x - x.mean(axis=0)
    assert len(cells) == 300 * 301 // 2 and not cells.duplicated(["i", "j"]).any() and np.allclose(cells.k, (y @ y.T)[cells.i, cells.j])


def test_centred_query_moves_no_cells(spark):
    from latentspark.plans.registry import queries

    plan = queries()["double_center"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan[: plan.index("MapInArrow")] for w in ("Join", "Exchange"))


def test_vectors_of_the_eigensolver_stay_distributed(spark, monkeypatch):
    """What reaches the driver in a round is sums of the block's products, whatever the nodes."""
    from pyspark import RDD

    n, k = 90, 4
    ring = np.eye(n) - (np.eye(n, k=1) + np.eye(n, k=-1) + np.eye(n, k=1 - n) + np.eye(n, k=n - 1)) / 2
    ring[3, 40] = ring[40, 3] = -0.3
    i, j = np.nonzero(ring)
    cells = blocks.cut_lineage(spark.createDataFrame(list(zip((i * 5).tolist(), (j * 5).tolist(), ring[i, j].tolist(), strict=True)), "src long, dst long, l double").repartition(5))
    reduced, reduce = [], RDD.treeReduce
    monkeypatch.setattr(RDD, "treeReduce", lambda self, *a: reduced.append(reduce(self, *a)) or reduced[-1])
    monkeypatch.setattr(spectral, "PART_ROWS", 20)
    held = spectral._Cells(cells, np.arange(n) * 5)
    values, parts = spectral._smallest(held, k)
    assert held.count > 1 and isinstance(parts, RDD) and max(x.size for x in reduced) == 2 * (k + spectral.SPARE) ** 2
    vectors = np.concatenate([v for _, v in sorted(parts.collect(), key=lambda x: x[0])])
    assert np.allclose(values, np.linalg.eigvalsh(ring)[:k], atol=1e-9)
    assert np.abs(ring @ vectors - vectors * values).max() < 1e-6 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("n", [1, 5, 64, 65, 300, 1000])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_a_block_are_those_of_a_whole_sort(n, k):
    """Bounds from groups of columns lose no neighbour and no tie; ids break ties of the root."""
    rng = np.random.default_rng(n + k)
    a, b = (blocks.Block(rng.permutation(m).astype(np.int64).tobytes(), m, np.round(rng.normal(size=(m, 2)), 1).tobytes(), b"") for m in (150, n))
    got = pairs.first_of(a, b, k, own=True)
    expected = []
    for i, x in zip(a.ids.tolist(), a.v, strict=True):
        d = np.sqrt(pairs.sq_dists(x[None], b.v))[0]
        order = [q for q in np.lexsort((b.ids, d)) if b.ids[q] != i][:k]
        expected += [(i, d[q]) for q in order]
    assert got["src"].tolist() == [i for i, _ in expected] and np.allclose(got["d"], [d for _, d in expected], atol=1e-7)
    firsts = np.flatnonzero(np.diff(got["src"], prepend=-1))
    same = (np.diff(got["d"], append=np.inf) == 0) & (np.diff(got["src"], append=-1) == 0)
    assert (got["dst"][np.flatnonzero(same)] < got["dst"][np.flatnonzero(same) + 1]).all() and (n < 2 or len(firsts) == 150)


def test_nearest_cells_of_a_pair_are_made_a_few_rows_at_a_time():
    """256 rows of cells took 40 MB beside the blocks."""
    import tracemalloc

    rng = np.random.default_rng(0)
    a, b = (blocks.Block(np.arange(m).tobytes(), m, rng.normal(size=(m, 4)).tobytes(), b"") for m in (256, 8192))
    tracemalloc.start()
    pairs.first_of(a, b, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
