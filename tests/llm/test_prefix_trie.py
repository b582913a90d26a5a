import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from latentspark.llm import prefix_trie, queries
from latentspark.llm.common import load

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every member list, child set and subtree by itself."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv_id].append(((turn is not None, turn or 0, said), (role, text)))
    own = {c: [t[1] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        base = abs(c) // 100 * 100 * (-1 if c < 0 else 1)
        h = zlib.crc32(str(c).encode()) % 6
        whole = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    found = set()
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        listed = ",".join(map(str, ends.get(p, [])))
        found.add((who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return found


def made(seed, n=60, roles=("user", "assistant", None)):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv_id = rng.choice([rng.randint(-250, 250), rng.randint(0, 30), 100, 200, 0, -100])
        rows += [(conv_id, rng.choice([None, k, k]), rng.choice(roles), rng.choice(["a", "b", "ab", "", None, "\U0001d518é,\n"])) for k in range(rng.randint(1, 4))]
    return rows


def result(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_members(spark, seed):
    rows = made(seed)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3)) == sorted(brute(rows), key=str)


def test_awkward_rows(spark):
    """Nulls in every column, ties, repeated rows, a turnless conversation, an absent base, long texts and clashing names."""
    turnless = next(c for c in range(701, 800) if prefix_trie.shared_turns(c) >= 1)
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "long " * 300_000), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (101, 1, "a:", "b"), (101, 2, "a", ":b"), (100, 0, "user", "base"), (turnless, 0, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("family", "hash", "key", "depth", "chars", "ends", "up", "owner", "leaf"):
        df = df.withColumn(name, F.lit("clash"))
    got = result(df)
    assert got == sorted(brute(rows), key=str)
    assert (1, 0, None) in {r[:3] for r in got}
    (ends,) = {r[-1] for r in got if r[1] == 0}
    assert ends in {hashlib.sha256(x.encode()).hexdigest() for x in (f"{turnless}", f"1,{turnless}", f"101,{turnless}", f"1,101,{turnless}")}
    assert result(df.where("false")) == []


def test_paths_that_hang_on_one_another(spark):
    """Conversations of 1, 2, 3 ... turns of one text: every path hangs on the one before."""
    ids = [c for c in range(1000, 1400) if prefix_trie.shared_turns(c) == 0][:40]
    rows = [(c, k, "user", "same") for n, c in enumerate(ids) for k in range(n + 1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == sorted(brute(rows), key=str)
    branching = [(c, k, "user", "same" if k < n else "last") for n, c in enumerate(ids) for k in range(n + 1)]
    assert result(spark.createDataFrame(branching, SCHEMA)) == sorted(brute(branching), key=str)


def test_only_nodes_of_families_are_merged(spark):
    """A third of all rows are copies of one conversation: a family gives one row for each of its nodes."""
    ids = [c for c in range(2000, 6000) if prefix_trie.shared_turns(c) == 0]
    rows = [(c, k, "user", f"copy {k}") for c in ids for k in range(3)]
    families = prefix_trie.family_nodes(spark.createDataFrame(rows, SCHEMA))
    assert families.count() == 4 * len({c // 100 for c in ids})
    assert [r[:7] for r in result(spark.createDataFrame(rows, SCHEMA))][1:] == [(ids[0], d, ids[0], len(ids), int(d < 3), 1, (len(ids) - 1) * 6 * (4 - d)) for d in (1, 2, 3)]


def test_query_takes_every_conversation(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op11_prefix_trie(spark, sf).collect()} == brute(rows)
