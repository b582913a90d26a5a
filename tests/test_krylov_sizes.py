"""How often the Gram is met, and what the driver holds of its basis."""

import numpy as np

from latentspark.functions.kernels import Kernel, median_of
from latentspark.operators.align import kernel as kernel_maps
from latentspark.operators.align import krylov
from latentspark.operators.align.kernel import Centred, ResidualSolver, RKHSAligner
from latentspark.operators.diagnostics import alternating_fit

RNG = np.random.default_rng(0)
X = RNG.normal(size=(300, 3))
Y = np.sin(X @ RNG.normal(size=(3, 2))) + 0.1 * RNG.normal(size=(300, 2))


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, v array<double>").repartition(3)


class Dense:
    """A Gram in memory that counts its products."""

    def __init__(self, spark, kernel, right, left=None):
        self.cells, self.n, self.met = kernel.block(right if left is None else left, right), len(right if left is None else left), 0

    def __call__(self, q):
        self.met += 1
        return self.cells @ q


def test_a_basis_is_made_for_the_lambda_selected(spark, monkeypatch):
    made, start = [], krylov.KrylovSolver.__init__
    monkeypatch.setattr(krylov.KrylovSolver, "__init__", lambda self, gram, x, e, least, *a: made.append(least / len(x)) or start(self, gram, x, e, least, *a))
    monkeypatch.setattr(kernel_maps, "DistributedGram", Dense)
    monkeypatch.setattr(kernel_maps, "MAX_GRAM", 100)
    grid = (1e-6, 1e-1, 1.0)
    noisy = X + 3 * RNG.normal(size=X.shape)
    m = RKHSAligner(lam_grid=grid).fit(frame(spark, noisy), frame(spark, Y))
    assert m.lam_used > grid[0] and np.allclose(made, [grid[0], m.lam_used])


def test_weights_of_few_lambdas_at_a_time_select_alike(spark, monkeypatch):
    one = RKHSAligner().fit(frame(spark, X), frame(spark, Y))
    monkeypatch.setattr(kernel_maps, "WEIGHT_BYTES", 1)
    assert RKHSAligner().fit(frame(spark, X), frame(spark, Y)).lam_used == one.lam_used


def test_blocks_beyond_the_drivers_share_lie_in_files(monkeypatch):
    monkeypatch.setattr(krylov, "HELD_BYTES", 50_000)
    kernel = Kernel().fitted(median_of(X))
    solver = krylov.KrylovSolver(Dense(None, kernel, X), X, Y, 1e-4 * len(X))
    held = [b for b in solver.blocks.kept if not isinstance(b, str)]
    assert sum(b.nbytes for b in held) <= 50_000 < solver.blocks.bytes
    exact = ResidualSolver(Centred(kernel, X).gram, X, Y).solve(1e-4 * len(X))
    assert np.abs(solver.solve(1e-4 * len(X)) - exact).max() <= 1e-6 * np.abs(exact).max()


def test_residuals_less_images_of_x_take_no_products():
    kernel, moved = Kernel().fitted(median_of(X)), RNG.normal(size=(3, 2))
    for orthogonal in (True, False):
        gram = Dense(None, kernel, X)
        solver = krylov.KrylovSolver(gram, X, Y, 1e-2 * len(X), orthogonal)
        before, exact = gram.met, ResidualSolver(Centred(kernel, X).gram, X, Y - X @ moved, orthogonal).solve(1e-2 * len(X))
        assert np.abs(solver.solve(1e-2 * len(X), moved) - exact).max() <= 1e-6 * np.abs(exact).max() and gram.met == before
        assert np.allclose(ResidualSolver(Centred(kernel, X).gram, X, Y, orthogonal).solve(3.0, moved), ResidualSolver(Centred(kernel, X).gram, X, Y - X @ moved, orthogonal).solve(3.0))


def test_alternating_stages_share_a_solver(spark, monkeypatch):
    made, solver_of = [], RKHSAligner.solver_of
    monkeypatch.setattr(RKHSAligner, "solver_of", lambda *a, **k: made.append(1) or solver_of(*a, **k))
    alternating_fit(frame(spark, X), frame(spark, Y), lam=1e-2, rounds=4, orthogonal=True)
    assert len(made) == 1


def test_products_come_by_tiles(monkeypatch):
    met, block = [], Kernel.block
    monkeypatch.setattr(Kernel, "block", lambda self, a, b, out=None: met.append(len(a) * len(b)) or block(self, a, b, out))
    z, w, kernel = RNG.normal(size=(500, 3)), RNG.normal(size=(300, 2)), Kernel("rbf", gamma=0.3)
    monkeypatch.setattr(krylov, "TILE", (64, 128))
    got = krylov.kernel_product(kernel, z, X, w)
    assert max(met) <= 64 * 128 and np.allclose(got, block(kernel, z, X) @ w)
    centred = Centred(kernel, X)
    assert np.allclose(centred.times(z, w), centred(z) @ w) and centred.times(z[:0], w).shape == (0, 2)
