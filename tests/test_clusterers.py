"""Clusterers through one door."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.functions.kernels import sq_dists
from latentspark.operators import pilots
from latentspark.operators.clusterers import NOISE, Lloyd, TrimmedLloyd, clustered


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "sample_id long, v array<double>, label int").repartition(5)


@pytest.fixture(scope="module")
def clumps():
    rng = np.random.default_rng(0)
    return np.repeat(np.array([[0.0, 0], [20, 0], [0, 20]]), [60, 30, 10], axis=0) + rng.normal(size=(100, 2))


def labels(df):
    return np.array([r.cluster for r in df.orderBy("sample_id").collect()])


def test_k_means_is_settled_and_kept_apart(spark, clumps):
    df = clustered(frame(spark, clumps), Lloyd(3))
    assert df.columns == ["sample_id", "v", "label", "cluster"]
    got = labels(df)
    assert len({*got[:60]}) == len({*got[60:90]}) == len({*got[90:]}) == 1 and len(set(got)) == 3
    centres = np.array([clumps[got == j].mean(axis=0) for j in range(3)])
    assert (sq_dists(clumps, centres).argmin(axis=1) == got).all()


def test_noise_is_no_anchor_and_no_pilot(spark, clumps):
    x = np.concatenate([clumps, [[200.0, 200.0]]])
    df = clustered(frame(spark, x), TrimmedLloyd(4, reach=8.0))
    got = labels(df)
    assert got[100] == NOISE or (got == got[100]).sum() == 1
    df = clustered(frame(spark, x), _Fixed())
    assert labels(df)[100] == NOISE
    means = {r.anchor: r.centroid for r in pilots.prototypes(df, df.select("sample_id", "cluster"), 5).collect()}
    assert set(means) == {0, 1} and pilots.support(df.select("sample_id", "cluster"), 5).count() == 10
    chosen = {r.sample_id for r in pilots.select_pilots(frame(spark, x), 2, "kmeans", clusterer=_Fixed()).collect()}
    assert len(chosen) == 2 and 100 not in chosen


def _Fixed():
    """A clusterer of one's own, by value: halves of the plane, and what is far from both is noise."""

    class Halves:
        rounds = 1

        def start(self, rows):
            return float(np.median(rows[:, 0]))

        def partial(self, state, rows):
            return len(rows)

        def merge(self, one, other):
            return one + other

        def finish(self, state, part):
            assert part == 101
            return state, True

        def assign(self, state, rows):
            return np.where(np.abs(rows).max(axis=1) > 100, -1, (rows[:, 0] > state).astype(int))

    return Halves()


def test_no_rows(spark, clumps):
    assert clustered(frame(spark, clumps).where(F.lit(False)), Lloyd(2)).count() == 0
