import numpy as np
import pytest
from pyspark.sql import functions as F

from latentspark.llm import queries, whitening
from latentspark.llm.common import load

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=32):
    """By centring in long doubles and a dense eigenproblem."""
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    centred = scaled.astype(np.longdouble) / n
    values, vectors = np.linalg.eigh((centred.T @ centred / n).astype(float))
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, (scaled**2).sum(1).tolist(), values / values.sum(), (centred @ vectors[:, :components] / np.sqrt(values[:components])).astype(float)


def compare(got, vectors, components=32):
    n, deviation, explained, whitened = brute(vectors, components)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table - whitened * signs).max() < 1e-7
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation and set(got.n) == {n}
    shares = got[got.vec_id == one.vec_id.iloc[0]].sort_values("component").explained.to_numpy()
    assert np.abs(shares / explained[: len(shares)] - 1).max() < 1e-6
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-6


def test_query_is_the_dense_solution_on_every_vector(spark):
    sf = "/root/testdata/sf0.01"
    rows = load(spark, sf, "embeddings").orderBy("vec_id").collect()
    got = queries.op13_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(rows)
    compare(got, [r.embedding for r in rows])


def test_a_large_common_offset_costs_no_digits(spark):
    """Entries near 10,000 that differ by less than one: products of uncentred rows would lose twelve digits."""
    rng = np.random.default_rng(0)
    vectors = (10_000 + rng.normal(size=(300, 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.3])).astype(np.float32).tolist()
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA), 4).toPandas()
    assert len(got) == 4 * 300
    compare(got, vectors, 4)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [*enumerate(good), (40, None), (41, []), (42, [1.0, None, 2.0]), (43, [1.0, float("nan"), 2.0]), (44, [float("inf"), 0.0, 0.0]), (None, good[0]), (3, good[3]), (3, good[3])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("x", "v", "n", "row", "whitened", "component", "deviation"):
        df = df.withColumn(name, F.lit("clash"))
    got = whitening.whiten(df).toPandas()
    assert len(got) == 43 * 3
    assert set(got[got.vec_id.notna()].vec_id) == set(range(40)) and got.vec_id.isna().sum() == 3
    one = got[got.component == 2]
    assert one[one.vec_id == 3].whitened.nunique() == 1 and len(one[one.vec_id == 3]) == 3
    assert got.identity_error.iloc[0] < 1e-9
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 40")).count() == 0


def test_directions_without_variance_have_no_value(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(50, 1)).astype(np.float32)
    vectors = np.hstack([flat, flat, np.ones_like(flat)]).tolist()
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert got.identity_error.iloc[0] < 1e-9 and abs(got[got.component == 1].explained.iloc[0] - 1) < 1e-12
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, 0.0, None, 0)}


def test_widths_and_sizes_that_are_errors(spark):
    with pytest.raises(Exception, match="more than one width"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], SCHEMA))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 1e12])], SCHEMA))


def test_deviation_is_exact_or_null():
    assert whitening._deviations(np.array([[3, 4], [2**31, 0]])) == [25, 2**62]
    assert whitening._deviations(np.array([[2**40, 1], [1, 1]])) == [None, 2]
