"""Queries without SQL that must take in every row of their tables."""

import numpy as np
import pytest

import __spark_entry__
from latentspark.functions.kernels import MEDIAN_ROWS, Kernel, median_of
from latentspark.operators import spectral
from latentspark.operators.align.kernel import fitted_kernel

QUERIES = __spark_entry__.queries()
LARGE, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def test_spectral_queries_use_every_row(spark):
    assert QUERIES["hks"](spark, LARGE).select("node").distinct().count() == 2000
    assert QUERIES["stitched_rows"](spark, LARGE).select("sample_id").distinct().count() == 2000


def test_beyond_the_dense_limit_the_signatures_are_the_same(spark, monkeypatch):
    dense = {(r.node, r.t_index): r.hks for r in QUERIES["hks"](spark, SMALL).collect()}
    monkeypatch.setattr(spectral, "MAX_DENSE", 100)
    sparse = {(r.node, r.t_index): r.hks for r in QUERIES["hks"](spark, SMALL).collect()}
    assert dense.keys() == sparse.keys() and max(abs(dense[k] - sparse[k]) for k in dense) < 1e-5


def test_matching_is_over_all_held_out_rows(spark):
    rows = QUERIES["cka_match"](spark, LARGE).collect()
    assert len({r.sample_id for r in rows}) == len({r.matched for r in rows}) == 400
    assert any(r.sample_id // 500 != r.matched // 500 for r in rows)


def test_bandwidth_counts_later_ids():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(MEDIAN_ROWS, 4)), rng.normal(size=(MEDIAN_ROWS, 4)) * 10])
    same = Kernel().fitted(median_of(x))
    got, prefix = fitted_kernel(Kernel(), x), Kernel().fitted(median_of(x[:MEDIAN_ROWS]))
    at = [float(k.block(x[:1], x[1:2] + 3)[0, 0]) for k in (got, same, prefix)]
    assert abs(at[0] - at[1]) < 0.1 * abs(at[2] - at[1])
    assert fitted_kernel(Kernel(), x[:MEDIAN_ROWS]) == prefix
