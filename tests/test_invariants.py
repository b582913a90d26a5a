"""What the invariant queries must say, whatever the tables hold."""

import numpy as np
import pytest

import __spark_entry__
from latentspark.plans import invariant_queries as Q
from latentspark.sources import fixtures as X

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def matrix(spark, name):
    found = rows(spark, name)
    out = np.full((max(r[0] for r in found) + 1, max(r[1] for r in found) + 1), np.nan)
    for i, j, value in found:
        out[i, j] = value
    return out


@pytest.mark.parametrize("name,n", [("pca_correlation", X.WIDTH_B), ("procrustes_rotation", X.WIDTH_A), ("functional_map_identity", 12)])
def test_identities(spark, name, n):
    assert np.allclose(matrix(spark, name), np.eye(n), atol=2e-6 if name != "functional_map_identity" else 1e-4)


def test_charts_are_undone_on_every_row(spark):
    b = X.WIDTH_B
    assert set(rows(spark, "chart_inverses")) == {(m, k or 0, k or b, m != "pga" and k is None, 0.0) for m, k in Q.CHARTS}


def test_maps_of_a_space_to_itself(spark):
    assert {(r[0], r[1], r[2]) for r in rows(spark, "self_maps")} == {(m, 0.0, 1.0) for m in Q.SELF}


@pytest.mark.parametrize("name", ["residual_orthogonality", "lambda_refits", "channel_splits", "kernel_columns"])
def test_errors_are_nothing(spark, name):
    found = rows(spark, name)
    expected = {"residual_orthogonality": {"rkhs", "pca_rkhs"}, "lambda_refits": set(Q.LAMBDAS), "channel_splits": {c[0] for c in Q.CHANNELS}, "kernel_columns": {"rbf", "laplacian", "polynomial", "linear", "cosine"}}
    assert {r[0] for r in found} == expected[name]
    assert all(abs(x) < 1e-6 for r in found for x in r[1:] if isinstance(x, float))


def test_widths_of_channels(spark):
    assert {r[:2] for r in rows(spark, "channel_splits")} == {(name, k) for name, _, _, k in Q.CHANNELS}


def test_eigenpairs(spark):
    ((nodes, k, residual, skew, in_range),) = rows(spark, "spectrum_checks")
    assert (nodes, k, residual, skew, in_range) == (500, 12, 0.0, 0.0, True)
    assert rows(spark, "subspace_similarities") == [(1.0, 1.0, 0.0)]


def test_designs_fill_their_budget(spark):
    assert set(rows(spark, "design_sizes")) == {(d, 9, 9) for d in Q.DESIGNS}


def test_grids_hold_every_cell_once_with_scores(spark):
    found = QUERIES["grid_records"](spark, SF).collect()
    cells = {(r.source, r.target, r.method, r.symbols) for r in found}
    assert len(found) == len(cells) == 8 and {r.delivered for r in found} == {4, 8}
    assert all(0 < r.mrr <= 1 and r.nmse > 0 for r in found)
    surface = QUERIES["lambda_surface"](spark, SF).collect()
    assert {(r.variant, r.lam, r.n_pilots) for r in surface} == {(v, lam, n) for n in (20, 40) for v in ("rbf-0.5", "rbf-2") for lam in (1e-4, 1e-1)} | {(None, None, n) for n in (20, 40)}
    assert len({r.nmse for r in surface}) == len(surface) == 10


def test_geometry_and_stages(spark):
    assert all(r[:4] == (1.0, 1.0, 1.0, 1.0) and r[4] == 0.0 for r in rows(spark, "class_geometry_identity"))
    assert rows(spark, "stationary_stages") == [(True, 0.0, 0.0)]
    made = rows(spark, "synthetic_tables")
    assert {r[1:3] for r in made} == {("train", 400), ("test", 100)} and {r[3] for r in made} == {12, 16}
