"""Neighbours by balls against all pairs."""

import numpy as np
import pytest

from latentspark.operators import pairs
from latentspark.operators.balls import nearest_in_balls


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_id long, v array<double>").repartition(3)


def rows(df):
    return sorted((r.src, r.dst, round(r.d, 9), r.place) for r in df.select("src", "dst", "d", "place").collect())


@pytest.fixture(scope="module")
def clumps():
    rng = np.random.default_rng(0)
    return np.repeat(rng.normal(size=(12, 4)) * 20, 60, axis=0) + rng.normal(size=(720, 4))


def test_the_same_rows_and_most_pairs_skipped(spark, clumps):
    df = frame(spark, clumps)
    got = nearest_in_balls(df, None, 5, centres=40, block=40)
    assert rows(got.rows) == rows(pairs.nearest(df, None, 5))
    assert got.skipped > 0.5


def test_other_tables_and_few_rows_in_a_clump(spark, clumps):
    left, right = frame(spark, clumps[::7] + 0.3), frame(spark, clumps[:400], 5000)
    assert rows(nearest_in_balls(left, right, 3, centres=20, block=50).rows) == rows(pairs.nearest(left, right, 3))
    lonely = frame(spark, np.concatenate([clumps[:3], clumps[60:200]]))
    assert rows(nearest_in_balls(lonely, None, 6, centres=12, block=16).rows) == rows(pairs.nearest(lonely, None, 6))


def test_rows_without_structure_copies_and_no_rows(spark):
    x = np.random.default_rng(1).normal(size=(200, 12))
    got = nearest_in_balls(frame(spark, x), None, 4, centres=8, block=30)
    assert rows(got.rows) == rows(pairs.nearest(frame(spark, x), None, 4))
    same = np.repeat(x[:2], 40, axis=0)
    assert rows(nearest_in_balls(frame(spark, same), None, 3, centres=5, block=9).rows) == rows(pairs.nearest(frame(spark, same), None, 3))
    assert nearest_in_balls(frame(spark, x[:1]), None, 3).rows.count() == 0
    assert nearest_in_balls(frame(spark, x[:1]).where("false"), None, 3).rows.count() == 0
