"""The auction over blocks against shortest augmenting paths."""

import numpy as np
import pytest

from latentspark.operators import auction, linalg


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, v array<double>").repartition(3)


def dots():
    """A function of a function, which workers get by value."""
    return lambda a, b: a @ b.T


def solved(spark, x, y, scores, **settings):
    rows = sorted(auction.assign(frame(spark, x), frame(spark, y, 1000), scores, **settings).collect())
    assert [r.sample_id for r in rows] == list(range(len(x)))
    assert sorted(r.matched for r in rows) == list(range(1000, 1000 + len(x)))
    s = scores(x, y)
    assert all(r.score == pytest.approx(s[r.sample_id, r.matched - 1000], abs=1e-9) for r in rows)
    primal, dual = sum(r.score for r in rows), sum(r.price + r.profit for r in rows)
    best = linalg.assignment(-s)
    assert primal == pytest.approx(s[np.arange(len(x)), best].sum(), abs=1e-6)
    assert dual == pytest.approx(primal, abs=1e-6)
    return rows


@pytest.mark.parametrize("listed", [200, 6])
def test_one_group(spark, listed):
    """With short lists, too, which run out and are made again."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(90, 5)), rng.normal(size=(90, 5))
    solved(spark, x, y, dots(), listed=listed)


def test_groups_outbid_each_other(spark):
    """Two groups of twelve, to a coarse last step, within which sums of scores and of prices and profits must be."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(24, 4))
    y = x[rng.permutation(24)] + rng.normal(size=(24, 4)) * 0.3
    s = x @ y.T
    rows = auction.assign(frame(spark, x), frame(spark, y, 1000), dots(), listed=24, group=12, last_step=4e-3).collect()
    slack = 24 * 4e-3 * (s.max() - s.min())
    best = s[np.arange(24), linalg.assignment(-s)].sum()
    assert sorted(r.matched for r in rows) == list(range(1000, 1024))
    assert best - slack <= sum(r.score for r in rows) <= best + 1e-9 <= sum(r.price + r.profit for r in rows) + 1e-6 <= best + slack


def test_ties_one_row_and_no_rows(spark):
    solved(spark, np.ones((7, 2)), np.ones((7, 2)), dots())
    solved(spark, np.ones((1, 2)), np.ones((1, 2)), dots())
    assert auction.assign(frame(spark, np.ones((1, 2))).where("false"), frame(spark, np.ones((1, 2))).where("false"), dots).count() == 0
    with pytest.raises(ValueError):
        auction.assign(frame(spark, np.ones((2, 2))), frame(spark, np.ones((1, 2))), dots)
