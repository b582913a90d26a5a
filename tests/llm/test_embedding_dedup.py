import math

import tracemalloc

import numpy as np
import pytest

from latentspark.llm import embedding_dedup
from latentspark.llm.embedding_dedup import Graph, Rows, unit_vectors, verified_links

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id) of every row."""
    n = len(rows)
    fine = [r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    units = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if f else None for r, f in zip(rows, fine, strict=True)]
    links = [[j for j in range(n) if j != i and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((str(rows[i][0]), len(links[i]), str(min(ids) if ids else None)))
    return sorted(out)


def clusters(seed=0, n=60, d=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d)
        for k in range(int(rng.integers(1, 6))):
            rows.append((len(rows) * 3 % 1009, [float(x) for x in v * (k + 1) + rng.normal(size=d) * 0.12 * np.linalg.norm(v) / np.sqrt(d) * (k > 1)], i % 3))
    return rows


def awkward():
    v = [1.0, 2.0, 3.0, 4.0]
    return [(5001, None, 0), (5002, [0.0] * 4, 0), (5003, [1.0, None, 2.0, 3.0], 0), (5004, [1.0, float("nan"), 2.0, 3.0], 0), (5005, [float("inf"), 1.0, 1.0, 1.0], 0),
            (5006, v, None), (5007, v, 0), (5007, v, 0), (5008, v, 0), (5009, v, 1), (5010, [2.0, 4.0, 6.0, 8.0], 0), (5011, [1.0, 2.0], 0), (5012, [], 0), (None, v, 1), (None, [1e-30, 2e-30, 3e-30, 4e-30], 1)]


@pytest.mark.parametrize("shard_floats", [1 << 20, 200])
def test_matches_brute_force(spark, shard_floats):
    rows = clusters() + awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'clash' AS node", "'clash' AS component_id", "'clash' AS vector", "'clash' AS size")
    got = embedding_dedup.embedding_components(df, shard_floats=shard_floats).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_many_shards_and_many_copies(spark, monkeypatch):
    """Over twenty shards of one label in parts of three, with a group of copies that is a third of the rows."""
    monkeypatch.setattr(embedding_dedup, "QUERY_SHARDS", 3)
    monkeypatch.setattr(embedding_dedup, "HEAVY_PARTS", 20)
    rows = [(i, v, 0) for i, v, _ in clusters(7, 90)]
    rows += [(2000 + i, rows[4][1], 0) for i in range(len(rows) // 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = embedding_dedup.embedding_components(df, shard_floats=80).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    found = embedding_dedup.audits(df, shard_floats=80).collect()
    shards = {r.shard for r in found}
    assert len(shards) > 20 and len(found) == len(shards) ** 2 and all(r.recall >= 0.999 for r in found)


def test_a_cosine_of_exactly_the_limit_links(spark):
    """49 / 50: the longer vector has length 50, and scaling by anything but powers of two would round."""
    rows = []
    for k, scale in enumerate((1.0, 3.0, 1e-3, 7e30, 1e-30)):
        rows += [(10 * k, [scale, 0.0, 0.0, 0.0], k), (10 * k + 1, [49.0, 7.0, 5.0, 5.0], k), (10 * k + 2, [49.0, 7.0, 5.0, 5.01], k)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((got[10 * k], got[10 * k + 1], got[10 * k + 2]) == (1, 2, 1) for k in range(5))


def test_vectors_of_extreme_size():
    v = np.array([[1e300, 2e300, -1e300], [1e-300, 2e-300, -1e-300], [5e-324, 0, 0]])
    scaled = embedding_dedup.exactly_scaled(v)
    assert np.isfinite(scaled).all() and (np.abs(scaled).max(axis=1) >= 0.5).all() and np.allclose(unit_vectors(scaled)[0], unit_vectors(scaled)[1])


def test_empty_table(spark):
    assert embedding_dedup.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_group_of_copies_larger_than_the_beam():
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    vectors = np.concatenate([base + rng.normal(size=(700, 32)) * 0.02, rng.normal(size=(900, 32))])[rng.permutation(1600)]
    units = unit_vectors(vectors)
    left, right, _, _ = verified_links(Rows(units), Graph(units.astype(np.float32)), Rows(units), 0.98, True)
    exact = units @ units.T >= 0.98
    np.fill_diagonal(exact, False)
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact)), strict=True))


def test_graph_finds_neighbours_by_its_layers():
    rng = np.random.default_rng(3)
    units = unit_vectors(rng.normal(size=(3000, 16))).astype(np.float32)
    graph = Graph(units)
    assert len(graph.layers) > 1
    queries = unit_vectors(rng.normal(size=(200, 16))).astype(np.float32)
    entry = np.zeros((200, 1), np.int64)
    for at in range(len(graph.layers) - 1, 0, -1):
        entry = graph._search(at, queries, entry, 1)[0]
    found = graph._search(0, queries, entry, 32)[0]
    exact = np.argsort(-(queries @ units.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(e)) / 10 for f, e in zip(found.tolist(), exact.tolist(), strict=True)]) > 0.9


def test_marks_of_a_full_shard_of_small_width_are_bounded(monkeypatch):
    """Width 4: a beam's marks, one a query and node, would take 25 MB here and 17 GB in a shard of 262,144 nodes."""
    units = unit_vectors(np.random.default_rng(6).normal(size=(5000, 4))).astype(np.float32)
    graph = Graph(units)
    entry = np.zeros((5000, 1), np.int64)
    monkeypatch.setattr(embedding_dedup, "GATHER", 1 << 18)
    whole = graph._search(0, units, entry, 8)
    monkeypatch.setattr(embedding_dedup, "SEEN", 1 << 20)
    tracemalloc.start()
    some = graph._search(0, units, entry, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    assert all((a == b).all() for a, b in zip(whole, some, strict=True))


def test_failed_audit_widens_the_beam():
    rng = np.random.default_rng(4)
    units = unit_vectors(rng.normal(size=(400, 6)))
    graph = Graph(units.astype(np.float32))
    graph.layers[0][:] = -1  # a graph without links finds next to nothing until the beam is as wide as the shard
    left, _, beam, recall = verified_links(Rows(units[::2]), graph, Rows(units), 0.98, False)
    assert beam >= len(units) and recall == 1.0
    assert len(left) == (units[::2] @ units.T >= 0.98).sum()


@pytest.mark.parametrize("own", [True, False])
def test_a_large_group_does_not_hide_missed_pairs(own):
    rng = np.random.default_rng(5)
    base, single = rng.normal(size=32), rng.normal(size=(700, 32))
    pairs = np.repeat(rng.normal(size=(10, 32)), 2, axis=0) + rng.normal(size=(20, 32)) * 0.01
    place = rng.permutation(2720)
    units = unit_vectors(np.concatenate([base + rng.normal(size=(2000, 32)) * 0.02, single, pairs])[np.argsort(place)])
    lost = place[2700:]
    graph = Graph(units.astype(np.float32))
    for layer in graph.layers:  # no beam reaches the pairs
        layer[np.isin(layer, lost)] = -1
        layer[lost] = -1
    left, right, _, _ = verified_links(Rows(units), graph, Rows(units), 0.98, own)
    exact = units @ units.T >= 0.98
    if own:
        np.fill_diagonal(exact, False)
    found = np.zeros_like(exact)
    found[left, right] = left != right if own else True
    assert int((exact & ~found).sum()) == 0 and not (found & ~exact).any()
