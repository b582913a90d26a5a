"""What large tables rest on: work that is shared, and cells that are made in small tiles."""

import numpy as np

from pyspark.sql import functions as F

from latentspark.functions import vec
from latentspark.functions.kernels import Kernel
from latentspark.operators import blocks, greedy, pairs
from latentspark.plans import invariant_queries, space_queries


def test_herding_designs_share_their_means(spark, monkeypatch):
    """Both herding designs of one pool take one pass over all pairs."""
    passes = []

    def counted(*args):
        passes.append(1)
        return pairs.mean_kernel(*args)

    monkeypatch.setattr(greedy, "mean_kernel", counted)
    monkeypatch.setattr(invariant_queries, "mean_kernel", counted, raising=False)
    rows = {r.design: (r.pilots, r.ids) for r in invariant_queries.design_sizes(spark, "/root/testdata/sf0.001").collect()}
    assert len(passes) == 1 and set(rows.values()) == {(9, 9)}


def test_shared_means_give_the_same_picks(spark):
    x = np.random.default_rng(8).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, v array<double>")
    kernel = Kernel("rbf", gamma=0.2)
    for sign in (1, -1):
        assert greedy.herding(df, 12, kernel, sign, means=pairs.mean_kernel(df, None, kernel)).ids == greedy.herding(df, 12, kernel, sign).ids


def test_sums_come_by_tiles():
    """No array of cells is larger than a tile, and sums are those of the whole."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(130, 5)), rng.normal(size=(2500, 5))
    a, b = (blocks.Block(np.arange(len(v)).tobytes(), len(v), v.tobytes(), b"") for v in (x, y))
    met = []

    def cells(p, q):
        met.append(len(p.ids) * len(q.ids))
        return {"k": p.v @ q.v.T}

    got = blocks.both_sums(a, b, False, cells)
    assert max(met) <= 1 << 16
    assert np.allclose(got["k"], np.concatenate([(x @ y.T).sum(axis=1), (x @ y.T).sum(axis=0)]))
    assert got["n"].tolist() == [2500] * 130 + [130] * 2500


def test_kernel_cells_are_those_of_the_formula():
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=(70, 3)), rng.normal(size=(1100, 3))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    out = np.empty((70, 1100))
    for name, want in (("rbf", np.exp(-0.3 * d**2)), ("laplacian", np.exp(-0.3 * d)), ("linear", a @ b.T), ("polynomial", (a @ b.T + 1) ** 3)):
        kernel = Kernel(name, gamma=0.3)
        assert np.allclose(kernel.block(a, b), want, atol=1e-12) and kernel.block(a, b, out) is out and np.allclose(out, want, atol=1e-12)


def test_cells_are_rounded_without_decimals(spark):
    """Rounding by products gives what F.round gives, and the cells of a Gram's query take it."""
    rng = np.random.default_rng(11)
    values = [0.0, -0.0, 1e-7, -1e-7, 0.5, -0.5, 0.015625, -0.015625, 1e8 + 0.25, -3e12, float("nan"), float("inf"), float("-inf"), None, *rng.normal(size=5000).tolist(), *(100 * rng.normal(size=5000)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (3, 5):
        assert df.where(~vec.rounded(F.col("x"), places).eqNullSafe(F.round("x", places))).count() == 0
    for name in ("laplacian_gram", "linear_gram", "cosine_gram", "rbf_gram", "poly_gram", "double_center"):
        plan = getattr(space_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan, name
