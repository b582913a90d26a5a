import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from latentspark.llm import queries
from latentspark.llm.components import connected_components
from tests.llm.fixtures import DOCS, documents, frame
from tests.llm.test_line_rules import brute_base
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import check_sequences, library
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == COLUMNS, name
            after = {r.doc_id for r in docs.collect()}
            assert after <= before and after
            before = after
    assert {r.doc_id for r in docs.collect()} == before
    assert sorted(map(str, docs.drop("sequence_id", "offset").collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))


def plain_language(rows):
    """Stage 1 by loops: languages by out-of-place distance to profiles of the same rows."""
    taught = defaultdict(Counter)
    for doc_id, text, lang, *_ in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None and text is not None:
            taught[lang].update(grams(text))
    profile = {x: {g: k for k, g in enumerate(first(n))} for x, n in taught.items() if n}
    out = []
    for doc_id, text, _, source, n_chars in rows:
        mine = first(grams(text))
        if mine and profile:
            apart = {x: sum(abs(k - p[g]) if g in p else 400 for k, g in enumerate(mine)) for x, p in profile.items()}
            out.append((doc_id, text, min(sorted(apart), key=apart.get), source, n_chars))
    return out


def grams(text):
    text = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return Counter()
    text = f" {' '.join(text.split())} "
    n = Counter(text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1))
    del n[" "]
    return n


def first(n):
    return sorted(n, key=lambda g: (-n[g], sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))))[:400]


def plain_quality(rows):
    """Stage 2 by loops: lines in over 20 texts of a host, and in over 5 % of them or over 100, go; then the verdicts."""

    def key(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line.lower())).strip(" ")

    texts = defaultdict(set)
    for r in rows:
        texts[r[3]].add(r[1])
    counts = {h: Counter(k for t in found for k in {key(x) for x in t.split("\n")} if k) for h, found in texts.items()}
    out = []
    for doc_id, text, lang, source, _ in rows:
        n, limit = counts[source], max(20, min(0.05 * len(texts[source]), 100))
        bad = [x for x in text.split("\n") if n[key(x)] > limit]
        n_words, *_, failed = brute_base(text)
        left = n_words - sum(len(key(x).split(" ")) for x in bad)
        if not failed and not (bad and (left < 0.3 * n_words or left < 20)):
            clean = "\n".join(x for x in text.split("\n") if x not in bad)
            out.append((doc_id, clean, lang, source, len(clean)))
    return out


def plain_near_duplicates(rows):
    values = {}
    for r in rows:
        fp = brute_fingerprint(r[1])
        values[fp] = min(values.get(fp, r[0]), r[0])
    kept = set(brute_components(values, 2).values())
    return [r for r in rows if r[0] in kept]


def plain_mix(rows):
    """Stage 4 by loops: every row as often as its source's share asks for."""
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    bucket = {r[0]: int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:4], 16) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    targets, out = brute_targets(sizes, (1, 2, 3), 3), []
    for source, total in sizes.items():
        mine = [r for r in rows if r[3] == source]
        whole = int(targets[source] // total)
        need, best = targets[source] - whole * total, (targets[source] - whole * total, -1)
        for b in sorted({bucket[r[0]] for r in mine}):
            gap = abs(sum(size[r[0]] for r in mine if bucket[r[0]] <= b) - need)
            best = min(best, (gap, b), key=lambda x: x[0])
        for r in mine:
            out += [r] * (whole + (bucket[r[0]] <= best[1]))
    return out


def test_run_against_loops(spark, tmp_path):
    """The whole pipeline over a table with frequent lines, near copies and junk, stage by stage and as one run."""
    rng = random.Random(11)
    rows = [r for r in documents(4, 400) if r[0] is not None]
    rows = list({r[0]: r for r in reversed(rows)}.values())
    for i in range(40):
        words = rows[5 * i][1].split(" ") if rows[5 * i][1] else ["x"]
        words[rng.randrange(len(words))] += rng.choice(("", "s"))
        rows.append((5000 + i, " ".join(words), *rows[5 * i][2:]))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, plain = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for (name, stage), loops in zip(corpus_pipeline.STAGES, (plain_language, plain_quality, plain_near_duplicates, plain_mix), strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs, before, plain = spark.read.parquet(str(tmp_path / name)), len(plain), loops(plain)
        assert sorted(map(str, (tuple(r) for r in docs.collect()))) == sorted(map(str, plain)), name
        assert len(plain) != before and plain, name
    encode, expected = library(), []
    for doc_id, text, *_ in plain:
        ids = [*encode(text), 0]
        start = len(ids) % 2048 or 2048
        bounds = [0, *range(start, len(ids) + 1, 2048)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(expected)
    used = check_sequences(pieces, 2048)
    assert len(used) <= -(-sum(p.length for p in pieces) // 2048) + 1


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_rows(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows and ids, clashing names; and the same table without rows."""
    docs = frame(spark, documents()).where("false" if empty else "true")
    columns = docs.columns
    left = Counter(str(r.doc_id) for r in docs.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
            assert {str(r.doc_id) for r in rows} <= set(left)
            assert all(r.text for r in rows)
            left = Counter(str(r.doc_id) for r in rows)
            if name == "near_duplicates":
                assert max(left.values(), default=1) == 1
        else:
            assert sum(r.piece == 0 for r in rows) == sum(left.values())
        assert bool(rows) != empty


def test_every_query_has_a_whole_result(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        if name not in ("op1_embedding_dedup", "op7_packing", "op10_chat", "op11_prefix_trie", "op13_whitening"):  # rows of other tables, or pieces
            assert query(spark, SF).count() == documents, name


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(40)], None])
def test_components(spark, edges):
    rng = random.Random(1)
    edges = edges if edges is not None else [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root[v] for v in linked}
