"""Invariants of charts and maps on seeded data."""

import itertools

import numpy as np
import pytest

from latentspark.functions.kernels import Kernel
from latentspark.operators import linalg
from latentspark.operators.align.anchors import PPFEAligner, RelativeAligner, parseval_frame
from latentspark.operators.align.base import Aligner
from latentspark.operators.align.kernel import Centred, CKAAligner, KCCAAligner, ResidualSolver, RKHSAligner, local_cka
from latentspark.operators.align.linear import CCAAligner, LinearAligner, ProcrustesAligner, SVCCAAligner
from latentspark.operators.align.neural import DirectMLPAligner, Network, ResidualMLPAligner
from latentspark.operators.decoders import MLPProbe, RidgeProbe
from latentspark.operators.scaling import Scaler, ledoit_wolf, sphere_exp, sphere_log


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], "sample_id long, v array<double>").repartition(3)


def collected(df):
    return np.array([r.v for r in df.orderBy("sample_id").collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6)) @ np.diag([3, 2, 1.5, 1, 0.7, 0.5]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 2
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    return x, x @ q + np.sin(x @ rng.normal(size=(6, 6)) * 0.4), q


@pytest.mark.parametrize("method,n", [("none", None), ("center", None), ("standard", None), ("pca", None), ("whiten", None), ("whiten", 3), ("pca", 0.9), ("pga", None), ("whiten", 1.0)])
def test_scaler(spark, data, method, n):
    x = data[0]
    s = Scaler(method, n).fit(frame(spark, x))
    z = s.apply(x)
    if method == "whiten":
        assert np.allclose(np.cov(z.T, bias=True), np.eye(z.shape[1]), atol=1e-8)
    if method == "whiten" and n is None:
        assert np.allclose(s.forward, s.forward.T)
    if method == "pca":
        cov = np.cov(z.T, bias=True)
        assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-8)
        assert (s.forward[np.abs(s.forward).argmax(axis=0), range(s.out_dim)] > 0).all()
    assert s.is_invertible == (method != "pga" and n in (None, 1.0))
    if s.is_invertible:
        assert np.allclose(s.invert(z), x)
    assert np.allclose(collected(s.transform(frame(spark, x))), z)
    with pytest.raises(ValueError):
        s.apply(x[:, :2])


def test_rank_rules():
    spectrum = np.array([4.0, 3, 2, 1])
    assert [linalg.rank_for(spectrum, n) for n in (None, 2, 9, 0.4, 0.41, 1.0)] == [4, 2, 4, 1, 2, 4]
    for bad in (True, 0, 1.5, 0.0):
        with pytest.raises((ValueError, TypeError)):
            linalg.rank_for(spectrum, bad)
    assert 0 <= ledoit_wolf(np.diag(spectrum), 50, 50 * 120.0) <= 1


def test_sphere_maps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mu = x[0]
    assert np.allclose(sphere_log(mu, x[:1]), 0) and np.allclose(sphere_exp(mu, sphere_log(mu, x)), x)


def test_procrustes_recovers_a_rotation_and_a_scale(spark, data):
    x, _, q = data
    a = ProcrustesAligner(scaling=True, preprocess="center").fit(frame(spark, x), frame(spark, 3 * x @ q))
    assert a.scale == pytest.approx(3) and np.allclose(a.apply(x), 3 * x @ q)
    assert (a.regime, a.transmitted_symbols, a.map_parameters, a.paired_samples_used) == ("square", 6, 36, 240)
    assert ProcrustesAligner(preprocess="center").fit(frame(spark, x[:, :4]), frame(spark, x)).regime == "embedding"
    assert ProcrustesAligner(preprocess="center").fit(frame(spark, x), frame(spark, x[:, :4])).regime == "projection"


def test_linear_maps(spark, data):
    x, _, q = data
    y = x @ q @ np.diag([1, 2, 3, 4, 5, 6]) + 7
    a = LinearAligner(alpha=1e-12, fit_intercept=True, preprocess="center").fit(frame(spark, x), frame(spark, y))
    assert np.allclose(a.apply(x), y, atol=1e-5) and a.map_parameters == 42
    raw = LinearAligner(alpha=1e-12, fit_intercept=True, preprocess="none").fit(frame(spark, x), frame(spark, y))
    w = np.linalg.lstsq(x, y, rcond=None)[0]  # of the chart as it is; the intercept comes after
    assert np.allclose(raw.w, w, atol=1e-5) and np.allclose(raw.b, y.mean(axis=0) - x.mean(axis=0) @ w, atol=1e-5)
    o = LinearAligner(orthogonalize=True, preprocess="center").fit(frame(spark, x), frame(spark, y))
    assert np.allclose(o.w.T @ o.w, np.eye(6))


def test_cca_recovers_a_rotation_and_untruncated_svcca_is_cca(spark, data):
    x, _, q = data
    src, tgt = frame(spark, x), frame(spark, x @ q)
    a = CCAAligner(reg=1e-9, preprocess="center").fit(src, tgt)
    assert np.allclose(a.apply(x), x @ q, atol=1e-4) and np.allclose(a.correlations, 1, atol=1e-6)
    b = SVCCAAligner(svd_src=6, svd_tgt=6, reg=1e-9, preprocess="center").fit(src, tgt)
    assert np.allclose(a.apply(x), b.apply(x), atol=1e-4)
    assert SVCCAAligner(svd_src=3, svd_tgt=3, preprocess="center").fit(src, tgt).transmitted_symbols == 3


def test_rkhs_residual(spark, data):
    x, y, _ = data
    src, tgt = frame(spark, x), frame(spark, y)
    a = RKHSAligner(lam=1e-4, preprocess="center").fit(src, tgt)
    z = a.src.apply(x)
    g = a.centred(z) @ a.a
    assert np.abs(g.T @ z).max() < 1e-4 * np.abs(g).max() * len(x)
    rigid = ProcrustesAligner(preprocess="center").fit(src, tgt).apply(x)
    assert np.linalg.norm(a.apply(x) - y) < np.linalg.norm(rigid - y)
    assert np.allclose(a.set_lam(1e12).apply(x), rigid, atol=1e-6) and np.allclose(a.apply_linear(x), rigid)
    fresh = RKHSAligner(lam=0.01, preprocess="center").fit(src, tgt)
    assert np.allclose(a.set_lam(0.01).apply(x), fresh.apply(x))
    mean = RKHSAligner(lam=1e12, rigid_stage=False, orthogonal_residual=False, preprocess="center").fit(src, tgt)
    assert np.allclose(mean.apply(x), y.mean(axis=0), atol=1e-4)
    free = RKHSAligner(lam=1e-4, orthogonal_residual=False, preprocess="center").fit(src, tgt)
    zf = free.centred(z) @ free.a
    assert np.abs(zf.T @ z).max() > 1e3 * np.abs(g.T @ z).max()


def test_kernel_rows_do_not_depend_on_their_batch(data):
    x = data[0]
    c = Centred(Kernel("rbf", gamma=0.1), x[:50])
    assert np.allclose(c(x), np.concatenate([c(x[i : i + 1]) for i in range(len(x))]))
    h = np.eye(50) - 1 / 50
    assert np.allclose(c.gram, h @ Kernel("rbf", gamma=0.1).block(x[:50], x[:50]) @ h)


def test_units_of_lambda_are_one_path(data):
    x, y, _ = data
    s = ResidualSolver(Centred(Kernel("rbf", gamma=0.1), x).gram, x, y)
    live = s.s[s.s > 1e-10 * s.s.max()].mean()
    assert np.allclose(s.solve(0.01 * s.scale("trace")), s.solve(0.01 * live * s.scale("n")))
    assert s.scale("plain") == 1


def test_lambda_is_selected_from_the_grid(spark, data):
    x, y, _ = data
    a = RKHSAligner(preprocess="center").fit(frame(spark, x), frame(spark, y))
    assert a.lam_used in a.lam_grid and 1e-8 < a.lam_used < 1e2
    assert a.diagnostics()["gram_flatness"] >= 1


def test_linear_kernel_has_no_capacity(spark, data):
    x, y, _ = data
    assert RKHSAligner(kernel=Kernel("linear"), lam=1e-3, preprocess="center").fit(frame(spark, x), frame(spark, y)).diagnostics()["capacity"] == 0


def test_kcca(spark, data):
    x, y, _ = data
    a = KCCAAligner(n_canonical=5).fit(frame(spark, x), frame(spark, y))
    both = collected(a.receive(a.transmit(frame(spark, x))))
    assert np.allclose(both, a.apply(x)) and a.transmitted_symbols == 5
    assert 1 - np.sum((a.apply(x) - y) ** 2) / np.sum((y - y.mean(0)) ** 2) > 0.5
    assert a.log_association() > 0 and 0 <= a.independence_p(spark) <= 1 or np.isnan(a.independence_p(spark))


def test_relative_maps(spark, data):
    x, _, q = data
    src, tgt = frame(spark, x), frame(spark, x @ q)
    for a in (RelativeAligner(n_anchors=20, similarity="inner"), RelativeAligner(n_anchors=20, similarity="inner", anchor_transfer="prototypes", decode="ridge", decode_alpha=1e-10), RelativeAligner(n_anchors=40, similarity="inner", strategy="random", n_subspaces=2), PPFEAligner(n_anchors=12)):
        assert np.allclose(a.fit(src, tgt).apply(x), x @ q, atol=1e-4)
    f = parseval_frame(x)
    assert np.allclose(f.T @ f, np.eye(6)) and np.allclose(np.linalg.pinv(f), f.T)


def test_local_cka_is_the_cka_of_the_enlarged_base():
    rng = np.random.default_rng(2)
    x, y, z, c = rng.normal(size=(15, 4)), rng.normal(size=(15, 5)), rng.normal(size=(3, 4)), rng.normal(size=(2, 5))
    k = Kernel("rbf", gamma=0.2)

    def cka(a, b):
        h = np.eye(len(a)) - 1 / len(a)
        p, q = h @ k.block(a, a) @ h, h @ k.block(b, b) @ h
        return np.sum(p * q) / np.sqrt(np.sum(p * p) * np.sum(q * q))

    got = local_cka(k.block(z, x), np.ones(3), k.block(c, y), np.ones(2), k.block(x, x), k.block(y, y))
    assert np.allclose(got, [[cka(np.vstack([x, z[i]]), np.vstack([y, c[j]])) for j in range(2)] for i in range(3)])


def test_cka_maps_and_matches(spark, data):
    x, _, q = data
    a = CKAAligner(n_anchors=60, preprocess="center").fit(frame(spark, x), frame(spark, x @ q))
    assert 1 - np.sum((a.apply(x) - x @ q) ** 2) / np.sum((x @ q - (x @ q).mean(0)) ** 2) > 0.9
    order = np.random.default_rng(3).permutation(25)
    for method in ("lsa", "qap"):
        assert np.mean(order[a.match(x[100:125], (x @ q)[100:125][order], method)] == np.arange(25)) > 0.8
    b = CKAAligner(n_anchors=60, decode="match", preprocess="center").fit(frame(spark, x), frame(spark, x @ q))
    assert np.corrcoef(b.apply(x).ravel(), (x @ q).ravel())[0, 1] > 0.7


def test_networks(spark, data):
    x, y, _ = data
    src, tgt = frame(spark, x), frame(spark, y)
    for kind in (DirectMLPAligner, ResidualMLPAligner):
        losses = [kind(hidden=(12,), rounds=r).fit(src, tgt).network.loss for r in (1, 20, 100)]
        assert losses[0] > losses[1] >= losses[2]
        assert kind(hidden=(12,), rounds=2).fit(src, tgt).apply(x).shape == y.shape


def test_contract(spark, data):
    x, y, _ = data
    with pytest.raises(ValueError):
        ProcrustesAligner().fit(frame(spark, x), frame(spark, y[:-1]))
    with pytest.raises(ValueError):
        RKHSAligner(max_points=10).fit(frame(spark, x), frame(spark, y))
    with pytest.raises(RuntimeError):
        Aligner().apply(x)
    few = ProcrustesAligner().fit(frame(spark, x[:20]), frame(spark, y[:20]), src_context=frame(spark, x), tgt_context=frame(spark, y))
    assert np.allclose(few.src.mean, x.mean(axis=0)) and few.paired_samples_used == 20
    assert np.allclose(collected(few.transform(frame(spark, x))), few.apply(x))


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        cost = rng.normal(size=(n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[range(n), linalg.assignment(cost)].sum() == pytest.approx(best)


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    assert np.allclose(linalg.lbfgs(lambda v: (0.5 * (v - 1) @ a @ (v - 1), a @ (v - 1)), np.zeros(3)), 1, atol=1e-5)


def test_probes(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(3, size=300)
    x = rng.normal(size=(300, 6)) + 4 * np.eye(6)[y]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "sample_id long, v array<double>, label int")
    for probe in (RidgeProbe(), MLPProbe(hidden=16, epochs=40)):
        out = probe.fit(df).classify(df).toPandas()
        assert (out.label == out.predicted).mean() > 0.9
    onehot = np.eye(3)[y]
    z = np.column_stack([x, np.ones(300)])
    w = np.linalg.lstsq(z, onehot, rcond=None)[0]
    ridge = RidgeProbe(1e-12).fit(df)
    assert np.allclose(np.vstack([ridge.w, ridge.b]), w, atol=1e-6)


def test_costs_of_anchor_and_kernel_maps(spark, data):
    """Pilots that a map is made of, which is fewer than it was offered unless it regresses on them."""
    x, _, q = data
    x, y = x[:100], np.hstack([x[:100] @ q, x[:100, :2]])
    src, tgt = frame(spark, x), frame(spark, y)
    made = RelativeAligner(n_anchors=10).fit(src, tgt)
    assert (made.paired_samples_used, made.transmitted_symbols) == (10, 10)
    assert RelativeAligner(n_anchors=10, decode="ridge").fit(src, tgt).paired_samples_used == 100
    assert RelativeAligner(n_anchors=10, anchor_transfer="clusters").fit(src, tgt).paired_samples_used == 100
    few = RelativeAligner(n_anchors=10, anchor_transfer="prototypes", n_prototype_samples=3).fit(src, tgt)
    assert few.paired_samples_used <= 30 and few.transmitted_symbols == 10 and all(len(g) <= 3 for g in few.support)
    assert RelativeAligner().fit(src, tgt).transmitted_symbols == 6 and PPFEAligner().fit(src, tgt).transmitted_symbols == 8
    assert PPFEAligner().fit(src, tgt).paired_samples_used == 100
    for settings, used in (({}, 100), ({"readout": "target"}, 12), ({"decode": "match"}, 12)):
        assert CKAAligner(n_anchors=12, **settings).fit(src, tgt).paired_samples_used == used
    with pytest.raises(ValueError):
        RelativeAligner(strategy="random", anchor_transfer="clusters")


@pytest.mark.parametrize("settings", [{}, {"readout": "target"}, {"decode": "match"}, {"decode": "match", "match_temperature": 0.0}, {"strategy": "random"}])
def test_cka_channel(spark, data, settings):
    """Sending and receiving is the map itself."""
    x, y, _ = data
    a = CKAAligner(n_anchors=20, **settings).fit(frame(spark, x[:120]), frame(spark, y[:120]))
    df = frame(spark, x[120:150])
    whole = collected(a.transform(df))
    assert np.allclose(collected(a.receive(a.transmit(df))), whole) and np.isfinite(whole).all()
    if settings.get("match_temperature") == 0.0:
        targets = a.tgt.invert(a.pool)
        assert all((np.abs(targets - row).max(axis=1) < 1e-9).any() for row in whole)


def test_cka_match_of_unnormalised_kernels_needs_their_own_values(spark, data):
    x, y, _ = data
    a = CKAAligner(n_anchors=5, kernel=Kernel("linear"), decode="match").fit(frame(spark, x[:40]), frame(spark, y[:40]))
    with pytest.raises(ValueError):
        a.receive(frame(spark, x[:5]))


@pytest.mark.parametrize("settings,columns", [({"basis": "subset", "n_basis_src": 10, "n_basis_tgt": 10}, 10), ({"basis": "hybrid", "n_subset": 30, "n_basis_src": 8}, 8), ({"readout": "target"}, None), ({"bandwidth": "rule_of_thumb"}, None), ({"pool_rows": 50}, None), ({"basis": "subset", "n_basis_src": 0.1}, 12)])
def test_kcca_bases(spark, data, settings, columns):
    x, y, _ = data
    a = KCCAAligner(**settings).fit(frame(spark, x[:120]), frame(spark, y[:120]))
    assert columns is None or a.reduced.basis.shape[1] == columns
    assert np.mean((a.apply(x[120:]) - y[120:]) ** 2) < np.mean((y[120:] - y[:120].mean(axis=0)) ** 2)
    if "bandwidth" in settings:
        z = a.src.apply(x[:120])
        assert a.reduced.centred.kernel.gamma == pytest.approx(1 / (20 * z.var(axis=0).mean()))
    if "pool_rows" in settings:
        assert len(a.reduced.centred.points) == 50


def test_kernel_spec_makes_the_kernel_again():
    for k in (Kernel("rbf", scale=2.0), Kernel("polynomial", degree=2, coef0=0.5), Kernel("cosine")):
        assert Kernel(**k.spec()) == k
    assert Kernel("linear").summary() == {"kernel_name": "linear"}


def test_rigid_stage_of_the_residual_network(spark, data):
    x, _, q = data
    a = ResidualMLPAligner(hidden=(4,), rounds=5, preprocess="center").fit(frame(spark, x), frame(spark, x @ q))
    assert np.allclose(collected(a.transform_linear(frame(spark, x))), x @ q, atol=1e-6)


def test_independence_counts_both_bases(spark):
    """Degrees of freedom are the product of both bases, however few correlations are sent; false alarms are as rare as their level."""
    rng = np.random.default_rng(0)
    chi = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution
    x, y = rng.normal(size=(2, 200, 3))
    m = KCCAAligner(n_basis_src=6, n_basis_tgt=6, n_canonical=2, preprocess="standard").fit(frame(spark, x), frame(spark, y))
    assert m.bases == (6, 6) and len(m.correlations) == 2 and len(m.all_correlations) == 6
    statistic = (200 - 6.5) * -np.log1p(-(m.all_correlations**2)).sum()
    assert m.independence_p(spark) == pytest.approx(1 - chi(36.0).cumulativeProbability(float(statistic)), abs=1e-9)
    # 300 runs without Spark: only what _fit_rows sets is used.
    alarms = 0
    for _ in range(300):
        one = KCCAAligner(n_basis_src=2, n_basis_tgt=2, kernel=Kernel("rbf"), reg=1e-8)
        one.n_pilots = 150
        one._fit_rows(rng.normal(size=(150, 1)), rng.normal(size=(150, 1)), np.arange(150))
        alarms += one.independence_p(spark) < 0.05
    assert 3 <= alarms <= 32


@pytest.mark.parametrize("name", ["rbf", "linear", "polynomial"])
def test_matches_of_any_kernel_are_received_with_self_similarities(spark, data, name):
    x, y, _ = data
    m = CKAAligner(n_anchors=12, strategy="random", decode="match", kernel=Kernel(name)).fit(frame(spark, x), frame(spark, y))
    sent = m.self_similarity(frame(spark, x)).select("sample_id", "self_similarity").join(m.transmit(frame(spark, x)), "sample_id")
    whole = collected(m.transform(frame(spark, x)))
    assert np.allclose(collected(m.receive(sent, self_similarity="self_similarity")), whole, atol=1e-9)
    if name == "rbf":
        assert np.allclose(collected(m.receive(sent.drop("self_similarity"))), whole, atol=1e-9)
    else:
        with pytest.raises(ValueError):
            m.receive(sent)


@pytest.mark.parametrize("kind", [DirectMLPAligner, ResidualMLPAligner])
def test_networks_of_tables_are_those_of_the_driver(spark, data, kind):
    """Beyond max_points rows stay where they are; the fit is the same function from the same start."""
    x, y, _ = data
    settings = {"hidden": (5, 4), "rounds": 12, "preprocess": "whiten"}
    one = kind(**settings).fit(frame(spark, x), frame(spark, y))
    many = kind(**settings, max_points=50).fit(frame(spark, x), frame(spark, y))
    assert many.n_pilots == one.n_pilots == len(x)
    assert np.allclose(many.apply(x), one.apply(x), atol=1e-6)
    assert many.network.loss == pytest.approx(one.network.loss, rel=1e-8)


@pytest.mark.parametrize("settings", [{"strategy": "random", "prune_threshold": 0.7, "n_subspaces": 3}, {"strategy": "random", "decode": "ridge", "n_anchors": 9}])
def test_drawn_anchors_of_tables_are_those_of_the_driver(spark, data, settings):
    """Beyond max_points rows stay where they are, and no number of them is an error."""
    x, y, _ = data
    one, many = (RelativeAligner(**settings, max_points=n).fit(frame(spark, x), frame(spark, y)) for n in (4000, 50))
    assert np.allclose(many.apply(x), one.apply(x), atol=1e-8)
    assert many.summary() == one.summary()


@pytest.mark.parametrize("kind,settings,used", [(RelativeAligner, {"parseval": True}, 8), (RelativeAligner, {"anchor_transfer": "prototypes", "n_prototype_samples": 3}, 24), (PPFEAligner, {}, None), (CKAAligner, {}, None)])
def test_clustered_anchors_of_tables(spark, kind, settings, used):
    """Of rows in clear clusters any k-means finds the same anchors."""
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(8, 5)) * 50, 20, axis=0) + rng.normal(size=(160, 5)) * 0.01
    y = x @ rng.normal(size=(5, 5))
    one, many = (kind(n_anchors=8, preprocess="center", max_points=n, **settings).fit(frame(spark, x), frame(spark, y)) for n in (4000, 50))
    assert many.paired_samples_used == (used or 160) and many.transmitted_symbols == one.transmitted_symbols == 8
    assert np.abs(many.apply(x) - one.apply(x)).max() < 1e-3 * np.abs(one.apply(x)).max()


@pytest.mark.parametrize("kind,settings", [(CKAAligner, {"n_anchors": 20, "strategy": "random"}), (CKAAligner, {"n_anchors": 20, "strategy": "random", "readout": "target"}), (CKAAligner, {"n_anchors": 12, "strategy": "random", "decode": "match"}), (KCCAAligner, {"n_canonical": 3}), (KCCAAligner, {"readout": "target", "pool_rows": 60})])
def test_kernel_channels_of_tables_are_those_of_the_driver(spark, data, kind, settings):
    x, y, _ = data
    one, many = (kind(**settings, max_points=n).fit(frame(spark, x), frame(spark, y)) for n in (24_000, 50))
    assert np.allclose(many.apply(x), one.apply(x), atol=1e-5)
    assert many.summary() == one.summary()


def test_a_step_of_a_tables_network_is_one_stage(spark, data, monkeypatch):
    """A step of few tasks has no shuffle, and one of many adds in two levels to the same sums."""
    x, y, _ = data
    both = spark.createDataFrame([(u.tolist(), v.tolist()) for u, v in zip(x, y, strict=True)], "x array<double>, y array<double>")
    tracker, fits, stages = spark.sparkContext.statusTracker(), [], []
    for few in (16, 1):
        monkeypatch.setattr("latentspark.operators.align.neural.FEW_TASKS", few)
        group, seen = f"network-{few}", []
        spark.sparkContext.setJobGroup(group, group)
        net = Network((4,), rounds=3)
        net.fit_table(both, len(x))
        seen = tracker.getJobIdsForGroup(group)
        stages.append(len(tracker.getJobInfo(max(seen)).stageIds))
        fits.append(net.flat)
    assert stages == [1, 2] and np.allclose(*fits, atol=1e-9)


def test_a_probe_learns_from_any_number_of_rows(spark):
    """Beyond max_rows rows stay where they are, and reruns agree."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 4)) + 3 * np.eye(3, 4)[y]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]) + 5) for i in range(600)], "sample_id long, v array<double>, label long").repartition(3)
    one, two = (MLPProbe(hidden=16, epochs=15, max_rows=200).fit(df) for _ in range(2))
    out = one.classify(df).toPandas()
    assert (out.label == out.predicted).mean() > 0.9
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(one.weights, two.weights, strict=True))
