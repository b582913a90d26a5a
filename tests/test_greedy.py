"""Greedy designs by certified candidates against one pass a pick."""

import numpy as np
import pytest

from latentspark.functions.kernels import Kernel, median_of, sq_dists
from latentspark.operators import greedy


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, v array<double>").repartition(4)


def herded(x, k, kernel, sign=1):
    gram = kernel.block(x, x)
    mu, s, picks = gram.mean(axis=1), np.zeros(len(x)), []
    for t in range(k):
        score = sign * (mu - (s / t if t else 0))
        score[picks] = -np.inf
        picks.append(int(np.flatnonzero(score >= score.max() - 1e-12).min()))
        s = s + gram[:, picks[-1]]
    return picks


def spread(x, k, first):
    d, picks = sq_dists(x, x), [first]
    while len(picks) < k:
        near = d[:, picks].min(axis=1)
        near[picks] = -1
        picks.append(int(np.flatnonzero(near >= near.max() - 1e-12).min()))
    return picks


@pytest.fixture(scope="module")
def pool():
    rng = np.random.default_rng(0)
    return rng.normal(size=(2000, 8)) * np.linspace(2, 0.5, 8) + 3 * rng.integers(0, 3, (2000, 1))


@pytest.mark.parametrize("name,sign", [("rbf", 1), ("rbf", -1), ("laplacian", 1)])
def test_512_of_2000_in_few_passes(spark, pool, name, sign):
    kernel = Kernel(name).fitted(median_of(pool))
    got = greedy.herding(frame(spark, pool), 512, kernel, sign)
    assert got.ids == herded(pool, 512, kernel, sign)
    assert got.passes < 20


@pytest.mark.parametrize("sign", [1, -1])
def test_few_candidates_take_more_passes_and_the_same_picks(spark, pool, sign):
    x = pool[:400]
    kernel = Kernel("rbf").fitted(median_of(x))
    got = greedy.herding(frame(spark, x), 120, kernel, sign, candidates=60)
    assert got.ids == herded(x, 120, kernel, sign)
    assert 1 < got.passes < 120


@pytest.mark.parametrize("kernel", [Kernel("linear"), Kernel("cosine"), Kernel("polynomial", degree=2)])
def test_kernels_without_a_bandwidth(spark, pool, kernel):
    x = pool[:120] - pool.mean(axis=0)
    for sign in (1, -1):
        assert greedy.herding(frame(spark, x), 25, kernel, sign, candidates=24).ids == herded(x, 25, kernel, sign)


def test_farthest_points_in_few_passes(spark, pool):
    got = greedy.farthest_points(frame(spark, pool), 512, 7)
    assert got.ids == spread(pool, 512, 7) and got.passes < 20
    few = greedy.farthest_points(frame(spark, pool[:400]), 100, 7, candidates=50)
    assert few.ids == spread(pool[:400], 100, 7) and 1 < few.passes < 100


def test_ties_copies_and_small_pools(spark):
    x = np.repeat(np.random.default_rng(1).normal(size=(6, 3)), 5, axis=0)
    kernel = Kernel("rbf", gamma=0.5)
    assert greedy.herding(frame(spark, x), 12, kernel, candidates=8).ids == herded(x, 12, kernel)
    assert greedy.farthest_points(frame(spark, x), 12, 3, candidates=8).ids == spread(x, 12, 3)
    assert sorted(greedy.herding(frame(spark, x), 99, kernel).ids) == list(range(30))
    assert greedy.herding(frame(spark, x).where("false"), 3, kernel).ids == []
    with pytest.raises(ValueError):
        greedy.farthest_points(frame(spark, x), 3, 999)
