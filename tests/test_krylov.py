"""Kernel solves from a distributed Gram against those of a dense one."""

import numpy as np
import pytest

from latentspark.functions.kernels import Kernel, median_of
from latentspark.operators.align.kernel import Centred, ResidualSolver, RKHSAligner
from latentspark.operators.align.krylov import DistributedGram, KrylovSolver
from latentspark.operators.diagnostics import alternating_fit


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    return x, np.sin(x @ rng.normal(size=(3, 2))) + 0.1 * rng.normal(size=(400, 2))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, v array<double>").repartition(3)


def test_products_are_those_of_the_gram(spark, data):
    x, y = data
    kernel, q = Kernel("rbf", gamma=0.3), np.random.default_rng(1).normal(size=(400, 3))
    assert np.allclose(DistributedGram(spark, kernel, x, block=150)(q), kernel.block(x, x) @ q)
    assert np.allclose(DistributedGram(spark, kernel, x, x[:50] + 1, block=150)(q), kernel.block(x[:50] + 1, x) @ q)


@pytest.mark.parametrize("orthogonal", [True, False])
def test_one_basis_solves_every_ridge(spark, data, orthogonal):
    x, y = data
    kernel = Kernel("rbf").fitted(median_of(x))
    dense = ResidualSolver(Centred(kernel, x).gram, x, y, orthogonal)
    found = KrylovSolver(DistributedGram(spark, kernel, x), x, y, 1e-4 * len(x), orthogonal)
    for lam in np.logspace(-4, 2, 17):
        exact = dense.solve(lam * len(x))
        assert np.abs(found.solve(lam * len(x)) - exact).max() <= 1e-6 * np.abs(exact).max()
    assert found.basis.shape[1] < len(x)


def test_maps_beyond_the_drivers_gram(spark, data):
    x, y = data
    settings = {"lam_grid": (1e-3, 1e-2, 1e-1)}
    one = RKHSAligner(**settings).fit(frame(spark, x), frame(spark, y))
    many = RKHSAligner(**settings, max_points=100).fit(frame(spark, x), frame(spark, y))
    assert many.n_pilots == 400 and many.lam_used == one.lam_used
    assert np.allclose(many.apply(x), one.apply(x), atol=1e-6)
    mapped = np.array([r.v for r in many.transform(frame(spark, x[:20])).orderBy("sample_id").collect()])
    assert np.allclose(mapped, one.apply(x[:20]), atol=1e-6)
    assert many.diagnostics()["lam"] == one.lam_used


def test_a_gram_beyond_the_drivers_share_stays_distributed(spark, data, monkeypatch):
    """Pilots within max_points whose Gram the driver should not hold; its values at the pilots come by products."""
    x, y = data
    one = RKHSAligner(lam=1e-2).fit(frame(spark, x), frame(spark, y))
    monkeypatch.setattr("latentspark.operators.align.kernel.MAX_GRAM", 100)
    many = RKHSAligner(lam=1e-2).fit(frame(spark, x), frame(spark, y))
    assert isinstance(many.solver, KrylovSolver) and many.centred.gram is None
    assert np.allclose(many.residual_rows(many.x), one.centred.gram @ one.a, atol=1e-6)
    # A smaller lambda than the basis was made for widens it.
    assert np.allclose(many.set_lam(1e-4).apply(x), one.set_lam(1e-4).apply(x), atol=1e-6)


def test_alternating_stages_beyond_the_drivers_gram(spark, data, monkeypatch):
    x, y = data
    one = alternating_fit(frame(spark, x), frame(spark, y), lam=1e-2, rounds=3, orthogonal=True)
    monkeypatch.setattr("latentspark.operators.align.kernel.MAX_GRAM", 100)
    many = alternating_fit(frame(spark, x), frame(spark, y), lam=1e-2, rounds=3, orthogonal=True)
    assert all(np.isclose(a[c], b[c], atol=1e-6) for a, b in zip(one, many, strict=True) for c in a)
