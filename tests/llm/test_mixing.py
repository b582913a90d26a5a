import re
from collections import Counter, defaultdict

import pytest

from latentspark.llm import mixing
from tests.llm.fixtures import documents, frame


def brute_targets(sizes, weights, cap):
    """Clamps one source after another until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= {s: cap * sizes[s] for s in above}


def test_targets_and_taken(spark):
    rows = documents(n=400)
    got = mixing.mixture(frame(spark, rows)).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    targets = brute_targets(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), n) for r, n in zip(rows, size, strict=True))
    taken, longest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] * 4 / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(frame(spark, rows)).collect()))


def test_rows_repeat_as_taken(spark):
    docs = frame(spark, documents())
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    repeats = Counter()
    for r in mixing.mixture(docs).collect():
        repeats[str((r.doc_id, r["size"]))] += r.repeats
    got = Counter(str((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))) for r in mixed.collect())
    assert got == +repeats


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    rows = documents()
    few = sorted(map(str, mixing.mixture(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mixture(frame(spark, rows)).collect())) == few


def test_empty_table_and_empty_texts(spark):
    assert mixing.mixture(frame(spark, documents()).where("false")).count() == 0
    rows = [(1, None, None, "a", 0), (2, "", None, None, 0)]
    assert {(r.target, r.taken) for r in mixing.mixture(frame(spark, rows)).collect()} == {(0.0, 0)}
    assert mixing.mix_rows(frame(spark, rows)).count() == 0
