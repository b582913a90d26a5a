"""Trie of the prefixes of rebuilt conversations, merged family by family.

Conversations of one base id (``conv_id - conv_id % 100``) are a family and share
the base's first turns. A family is cogrouped with its base's turns: each conversation
is rebuilt (the first h original turns of the base, then its own after its first h)
and put into the family's own small trie. Only that trie's nodes leave the task, a
row for each prefix that the family has, and are merged by prefix over all families.
Texts don't leave the scan: a turn is the SHA-256 of its role and text, and a prefix
the hash of its turns' hashes in turn (16 bytes).

Sums over subtrees don't walk the depths. The members of a node are fewer the
deeper it is, so its smallest member grows, and the nodes of one smallest member (the
``owner``) are one path. Paths hang on paths of smaller owners; their totals come from doubling
jumps over owners (logarithmic in how many paths hang on one another), and
within a path from a running sum from its end.

A node's ids are hashed by families in rising order, streamed through one SHA-256, so
that a node where very many conversations end needs no memory; all else of a
node that many families have is combined before it is shuffled. A family has at most 100
conversations (199 around zero); one conversation's turns are hashed in order by one task.

Defined cases: rows of a null conv_id are left out; ids divide as SQL does (-150 belongs
to -100, -50 to 0); turns are ordered by turn (null first), then the hash of role and text;
repeated rows are repeated turns; a null role or text is empty, and a text may be of any
length; an absent base gives no turns; a conversation without turns ends at
the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentspark.llm.common import cut_lineage
from latentspark.plans.shipping import ensure_importable

FAMILY, SHARED = 100, 6
KEY_BYTES = 16
ROOT = hashlib.sha256(b"").digest()[:KEY_BYTES]
NODES = "key binary, parent binary, family long, depth long, conv_id long, n_convs long, chars long, ends string"
#: Doubling reaches any height that fits a long.
MAX_ROUNDS = 64


def shared_turns(conv_id: int) -> int:
    """How many of its base's turns a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


def rebuilt(conv_id: int, own: list, base: list) -> list:
    h = shared_turns(conv_id)
    return base[:h] + own[h:]


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """``(family, conv_id, timed, turn, hash, chars)`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        (conv_id - conv_id % FAMILY).alias("family"), conv_id.alias("conv_id"), turn.isNotNull().alias("timed"), F.coalesce(turn, F.lit(0)).alias("turn"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("hash"), F.length(text).cast("long").alias("chars"),
    ).where("conv_id is not null")


def _turns(rows: pd.DataFrame) -> dict[int, list[tuple[bytes, int]]]:
    """Turns of each conversation, in order."""
    found: dict[int, list] = {}
    if "conv_id" not in rows:  # a side without rows comes without columns
        return found
    for conv_id, timed, turn, said, chars in zip(*(rows[c].tolist() for c in ("conv_id", "timed", "turn", "hash", "chars")), strict=True):
        found.setdefault(conv_id, []).append((timed, turn, bytes(said), chars))
    return {conv_id: [t[2:] for t in sorted(turns)] for conv_id, turns in found.items()}


def family_trie(members: dict[int, list], base: list) -> list[tuple]:
    """Nodes of a family: (key, parent, depth, smallest member, members, code points of the last text, ids of those that end)."""
    nodes: list[list] = [[ROOT, None, 0, None, 0, 0, []]]
    below: list[dict] = [{}]
    for conv_id in sorted(members):
        at = 0
        path = [0]
        for said, chars in rebuilt(conv_id, members[conv_id], base):
            if said not in below[at]:
                key = hashlib.sha256(nodes[at][0] + said).digest()[:KEY_BYTES]
                below[at][said] = len(nodes)
                nodes.append([key, nodes[at][0], nodes[at][2] + 1, None, 0, chars, []])
                below.append({})
            at = below[at][said]
            path.append(at)
        for node in path:
            nodes[node][3] = conv_id if nodes[node][3] is None else nodes[node][3]
            nodes[node][4] += 1
        nodes[at][6].append(conv_id)
    return [tuple(n) for n in nodes]


def _family_nodes(key: tuple, members: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    first = next(iter(_turns(base).values()), [])
    rows = family_trie(_turns(members), first[:SHARED])
    found = pd.DataFrame(rows, columns=["key", "parent", "depth", "conv_id", "n_convs", "chars", "ends"])
    found["ends"] = [",".join(map(str, ends)) or None for ends in found["ends"]]
    found.insert(2, "family", int(key[0]))
    return found


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie."""
    ensure_importable(conversations.sparkSession)
    turns = turn_hashes(conversations)
    # h is at most 5, but a base's turns have an order only once they are together.
    bases = turns.where("conv_id = family")
    return turns.groupBy("family").cogroup(bases.groupBy("family")).applyInPandas(_family_nodes, NODES)


def merge_families(families: DataFrame) -> DataFrame:
    """``(key, parent, depth, conv_id, n_convs, chars, n_children, up)`` of every prefix; up is the parent's smallest member."""
    same = lambda c: F.first(c).alias(c)
    nodes = families.groupBy("key").agg(same("parent"), same("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), same("chars"))
    nodes = cut_lineage(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(children, "key").select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    counted = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return cut_lineage(counted.join(parents, "parent", "left"))


def path_totals(nodes: DataFrame) -> DataFrame:
    """``(owner, up, at, leaves, saved)``: totals of each owner's path and of all that hangs on it, and the node that it hangs on."""
    own = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    tops = nodes.where("up <> conv_id").select(F.col("conv_id").alias("owner"), "up", (F.col("depth") - 1).alias("at"))
    state = cut_lineage(own.join(tops, "owner", "left").withColumn("jump", F.col("up")))
    for _ in range(MAX_ROUNDS):
        if state.where("jump is not null").isEmpty():
            return state.drop("jump")
        more = state.where("jump is not null").groupBy(F.col("jump").alias("owner")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = state.where("jump is not null").select(F.col("owner").alias("jump"), F.col("jump").alias("further"))
        added = state.join(more, "owner", "left").join(further, "jump", "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        state = cut_lineage(added.select("owner", "up", "at", *sums, F.col("further").alias("jump")))
    raise RuntimeError(f"paths hang on one another beyond {MAX_ROUNDS} doublings")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Every node with ``n_leaves`` and ``saved_tokens`` of its subtree."""
    weighed = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("chars")})
    hung = path_totals(weighed).where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
    hung = hung.agg(F.sum("leaves").alias("leaf"), F.sum("saved").alias("saving"))
    events = weighed.unionByName(hung, allowMissingColumns=True)
    # A conversation's own nodes and a row for each of them that others hang on.
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.withColumns({"n_leaves": F.sum("leaf").over(deeper), "saved_tokens": F.sum("saving").over(deeper)})
    return summed.where("key is not null")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each run of one key."""
    at, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(ends.encode())
        yield _hashed(done)
    if at is not None:
        yield _hashed([(at, digest.hexdigest())])


def _hashed(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def end_hashes(families: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the prefixes at which conversations end; families hold disjoint ranges of ids."""
    ends = families.where("ends is not null").select("key", "family", "ends")
    return ends.repartition("key").sortWithinPartitions("key", "family").select("key", "ends").mapInArrow(_hash_runs, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie; (conv_id, depth) names its last turn, turn ``depth`` of rebuilt conversation conv_id."""
    families = cut_lineage(family_nodes(conversations))
    nodes = subtree_sums(merge_families(families))
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(end_hashes(families), "key", "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
