import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from latentspark.llm import components, simhash
from tests.llm.fixtures import documents, frame


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, radius):
    """Smallest id reachable, for {fingerprint: smallest id}."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    keys = list(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for v in keys:
        least[find(v)].append(values[v])
    return {v: min(least[find(v)]) for v in keys}


def test_matches_brute_force(spark):
    rows = documents()
    got = simhash.simhash_components(frame(spark, rows)).collect()
    smallest = {}
    for r in rows:
        fp = brute_fingerprint(r[1])
        smallest[fp] = min(smallest.get(fp, 1 << 60), 1 << 60 if r[0] is None else r[0])
    component = brute_components(smallest, 2)
    none = {1 << 60: None}
    expected = sorted((str(r[0]), f"{brute_fingerprint(r[1]):016x}", str(none.get(component[brute_fingerprint(r[1])], component[brute_fingerprint(r[1])]))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


@pytest.mark.parametrize("tile_rows,segments,meet", [(8192, 1, 1 << 16), (8192, 2, 1 << 16), (8192, 3, 20), (16, 1, 20), (16, 4, 1 << 16), (64, 8, 64), (8192, 16, 1 << 16), (8, None, 8)])
def test_tiles_lose_no_link(spark, monkeypatch, tile_rows, segments, meet):
    monkeypatch.setattr(simhash, "MEET_ROWS", meet)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(120)]
    for v in values[:40]:
        for _ in range(3):
            v ^= 1 << rng.randrange(64)
            values.append(v)
            v ^= 1 << rng.randrange(64)
            values.append(v)
    distinct = {v: i for i, v in enumerate(dict.fromkeys(values))}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in distinct]
    pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), len(distinct), 2, tile_rows, segments)
    linked = {r.node: r.root for r in simhash.connected_components(pairs, "a", "b").collect()}
    of = defaultdict(list)
    for v, i in distinct.items():
        s = v - (1 << 64) if v >> 63 else v
        of[linked.get(s, s)].append(i)
    got = {i: min(group) for group in of.values() for i in group}
    assert got == {distinct[v]: c for v, c in brute_components(distinct, 2).items()}


@pytest.mark.parametrize("own", [True, False])
def test_blocks_lose_no_link(monkeypatch, own):
    monkeypatch.setattr(simhash, "TILE_ROWS", 7)
    monkeypatch.setattr(simhash, "BLOCK", 21)
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 16, 60).astype(np.uint64) << np.uint64(3) | rng.integers(0, 2, 60).astype(np.uint64) << np.uint64(40))
    rng.shuffle(values)
    left, right = values[: len(values) // 2], values[len(values) // 2 :]
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 1
    if not own:
        near[: len(left), : len(left)] = np.eye(len(left), dtype=bool)
    near[len(left) :, len(left) :] = np.eye(len(right), dtype=bool)
    reach = np.linalg.matrix_power(near.astype(np.int64), 40) > 0 if len(values) < 30 else None
    root = {int(v): int(v) for v in values}
    for a, b in zip(*simhash.tile_links(left, right, own, 1), strict=True):
        root[int(a)] = int(b)
    got = np.array([[root[int(a)] == root[int(b)] for b in values] for a in values])
    while reach is None or (reach != ((reach.astype(int) @ near) > 0)).any():
        reach = ((near if reach is None else reach).astype(int) @ near) > 0
    assert (got == reach).all()


def test_estimates():
    """The part of compared pairs and the cells of random fingerprints, and the rule's choice, which never falls with size."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 64, 3000, np.uint64, endpoint=False)
    for segments in (1, 2, 3, 5):
        bounds = np.cumsum([0, *simhash._widths(segments)])
        counts = np.stack([np.bitwise_count(values >> np.uint64(a) & np.uint64((1 << int(b - a)) - 1 if b - a < 64 else (1 << 64) - 1)).astype(int) for a, b in zip(bounds, bounds[1:])])
        apart = sum(np.abs(c[:, None] - c[None, :]) for c in counts)
        assert np.isclose(simhash._spread(segments, 2)[0], (apart <= 2).mean(), rtol=0.15)
        assert len(simhash._offsets(segments, 2)) == segments * (segments + 1)
    chosen = [simhash.segments_for(int(10**k)) for k in np.arange(1, 11, 0.25)]
    assert chosen == sorted(chosen) and chosen[0] == 1


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_dropped_ids_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
    docs = frame(spark, documents())
    kept = simhash.keep_one_per_component(docs)
    expected = simhash.simhash_components(docs).where("kept").select("doc_id").distinct().collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in expected)


def test_unfinished_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), "a", "b")


def test_one_row_of_each_component_stays(spark):
    rows = documents()
    kept = simhash.keep_one_per_component(frame(spark, rows)).collect()
    components = simhash.simhash_components(frame(spark, rows)).select("component_id").distinct().count()
    assert len(kept) == components
    assert {r.text for r in kept if r.doc_id == 3} <= {r[1] for r in rows if r[0] == 3}
    assert {"__id", "__row", "row", "id", "dropped_id"} <= set(kept[0].asDict()) and {r["__id"] for r in kept} == {"clash"}


def test_empty_table(spark):
    empty = frame(spark, documents()).where("false")
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one_per_component(empty).count() == 0


def test_long_text_is_read_in_chunks(monkeypatch):
    text = documents()[67][1]
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)
