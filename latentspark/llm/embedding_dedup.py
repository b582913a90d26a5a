"""Embedding near-duplicates through hierarchical navigable small-world graphs.

Equal vectors of a label are first made one node with a count. Nodes are dealt to
shards of about ``SHARD_FLOATS`` numbers; each shard gets a layered graph, built
in batches in numpy. Every shard of a label is queried with every node of that
label: the nodes' vectors are sent to it, a shard of them at a time, and its graph
goes once to each task, which takes up to ``QUERY_SHARDS`` such blocks of queries one
after another. A beam descends the layers, its candidates are verified by cosine in
double precision, and the components that they make in the task are completed by
exact cosines in blocks, so that a group of near copies larger than the beam is
linked whole. An audit compares queries of each shard pair with brute force: some
of all, some of those with links, some of those with few, which no completed group
hides, and up to ``AUDIT_UNLINKED`` drawn from those without any. The mean recall of
a query, not of a link, decides, so that a large group outweighs no pair. Until it
passes, the beam is doubled for all, and beyond ``WIDEST`` it is as wide as the
shard, which is brute force itself. ``audits`` returns the recall that each pair of
shards passed with.

A task returns for each node the number of vectors linked to it and its root in
the task's links, never all pairs; components are united over those roots.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite
components, or has a null label, links with nothing and is a component of its
own; a cosine within rounding of the limit is computed again from the vectors
themselves in extended precision, so that one of exactly 0.98 links; vectors of different lengths don't link; repeated rows link with each other;
a null vec_id never names a component unless all its vectors have none; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import bound_batches, cut_lineage
from latentspark.llm.components import connected_components

MIN_COSINE = 0.98
SHARD_FLOATS = 1 << 20
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
BUILD_BATCH = 256
AUDIT = 64
AUDIT_SPARSE = 512
AUDIT_UNLINKED = 2048
#: Brute force in blocks costs less than a wider beam.
WIDEST = 256
MIN_RECALL = 0.999
#: Single precision may move a cosine by this much; candidates within it are verified.
SLACK = 1e-4
#: Rounding in double precision moves a cosine by less than this.
ROUNDING = 1e-13
#: Shards whose nodes query a graph in one task.
QUERY_SHARDS = 16
#: Labels of which a row each may be broadcast, and vectors of over one part of so many of the rows, joined by broadcast.
BROADCAST_LABELS, HEAVY_PARTS = 100_000, 1000
#: Numbers gathered at a time while a beam expands.
GATHER = 1 << 22
#: Marks of nodes seen that a search holds at a time, a byte each.
SEEN = 64 << 20


def exactly_scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest numbers near 1, so that no square is lost."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class Rows:
    """Vectors of a shard: exactly scaled, and of length 1 in double and in single precision."""

    def __init__(self, scaled: np.ndarray) -> None:
        self.scaled = scaled
        self.units = unit_vectors(scaled)
        self.single = self.units.astype(np.float32)

    def __len__(self) -> int:
        return len(self.scaled)

    def __getitem__(self, some: np.ndarray) -> Rows:
        part = Rows.__new__(Rows)
        part.scaled, part.units, part.single = self.scaled[some], self.units[some], self.single[some]
        return part


def _linked(queries: Rows, nodes: Rows, left: np.ndarray, right: np.ndarray, cosine: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs those of cosine at least ``least``, the close ones by extended precision."""
    true = cosine >= least
    close = np.flatnonzero(np.abs(cosine - least) <= ROUNDING)
    for k in range(0, len(close), 1 << 14):
        some = close[k : k + (1 << 14)]
        a, b = queries.scaled[left[some]].astype(np.longdouble), nodes.scaled[right[some]].astype(np.longdouble)
        true[some] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= least
    return left[true], right[true]


def _blockwise(queries: Rows, nodes: Rows, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of cosine at least ``least``, over all pairs."""
    step = max(1, GATHER // max(1, len(nodes)))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(queries), step):
        cosine = queries.units[k : k + step] @ nodes.units.T
        left, right = np.nonzero(cosine >= least - ROUNDING)
        left, right = _linked(queries, nodes, k + left, right, cosine[left, right], least)
        lefts.append(left)
        rights.append(right)
    return np.concatenate(lefts), np.concatenate(rights)


class Graph:
    """A layered proximity graph over unit vectors, searched and built for many vectors at a time."""

    def __init__(self, units: np.ndarray, seed: int = 0) -> None:
        self.units = units
        n = len(units)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()
        self.layers = [np.full((n, DEGREE * (2 if at == 0 else 1)), -1, np.int32) for at in range(int(self.level.max()) + 1 if n else 0)]
        done = 1
        while done < n:
            some = np.arange(done, min(n, done + min(done, BUILD_BATCH)))
            self._insert(some)
            done += len(some)

    def _insert(self, some: np.ndarray) -> None:
        queries = self.units[some]
        entry = np.zeros((len(some), 1), np.int64)
        for at in range(len(self.layers) - 1, -1, -1):
            here = self.level[some] >= at
            ids, sims = self._search(at, queries, entry, 1)
            entry = ids[:, :1].copy()
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            ids, sims = self._search(at, queries[rows], entry[rows], BUILD_BEAM)
            mates = queries[rows] @ queries[rows].T
            np.fill_diagonal(mates, -np.inf)
            ids = np.concatenate([ids, np.broadcast_to(some[rows], (len(rows), len(rows)))], axis=1)
            sims = np.concatenate([sims, mates], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : BUILD_BEAM + DEGREE]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            chosen = self._choose(queries[rows], ids, sims, self.layers[at].shape[1])
            self.layers[at][some[rows]] = chosen
            self._link_back(at, some[rows], chosen)
            entry[rows] = np.where(np.isfinite(sims[:, :1]), ids[:, :1], entry[rows])

    def _choose(self, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Half spread-out neighbours, each nearer to the query than to those before it, half the nearest others."""
        sims = np.where(ids >= 0, sims, -np.inf)
        left, vectors, rows = sims.copy(), self.units[ids], np.arange(len(ids))
        out = np.full((len(ids), degree), -1, np.int32)
        rest = sims.copy()
        for k in range(degree // 2):
            best = left.argmax(axis=1)
            live = np.isfinite(left[rows, best])
            if not live.any():
                break
            out[live, k] = ids[rows, best][live]
            rest[rows[live], best[live]] = -np.inf
            near = np.einsum("rcd,rd->rc", vectors, vectors[rows, best])
            left[(near >= sims) & live[:, None]] = -np.inf
            left[rows, best] = -np.inf
        for row_start in range(0, len(ids), 4096):
            part = slice(row_start, row_start + 4096)
            order = np.argsort(-rest[part], axis=1, kind="stable")
            for r, choice in zip(range(part.start, part.start + len(order)), order, strict=True):
                free = np.flatnonzero(out[r] < 0)
                fill = choice[: len(free)]
                fill = fill[np.isfinite(rest[r, fill])]
                out[r, free[: len(fill)]] = ids[r, fill]
        return out

    def _link_back(self, at: int, some: np.ndarray, chosen: np.ndarray) -> None:
        layer = self.layers[at]
        degree = layer.shape[1]
        source = np.repeat(some, degree)
        target = chosen.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        # The nearest come first, so that what a crowded neighbour drops is farthest.
        order = np.lexsort((-np.einsum("pd,pd->p", self.units[source], self.units[target]), target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = min(int(counts.max(initial=0)), 2 * degree)
        place = np.arange(len(target)) - np.repeat(first, counts)
        fits = place < width
        extra = np.full((len(nodes), width), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = source[fits]
        has = (extra[:, :, None] == layer[nodes][:, None, :]).any(axis=2)
        extra[has] = -1
        ids = np.concatenate([layer[nodes].astype(np.int64), extra], axis=1)
        full = (ids >= 0).sum(axis=1) > degree
        easy = np.argsort(ids < 0, axis=1, kind="stable")[:, :degree]
        layer[nodes[~full]] = np.take_along_axis(ids, easy, 1)[~full]
        for start in range(0, int(full.sum()), 512):
            part = np.flatnonzero(full)[start : start + 512]
            sims = np.einsum("rcd,rd->rc", self.units[ids[part]], self.units[nodes[part]])
            layer[nodes[part]] = self._choose(self.units[nodes[part]], ids[part], sims, degree)

    def _search(self, at: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found for each query, best first (-1 and minus infinity where fewer)."""
        layer, n = self.layers[at], len(queries)
        expand = max(1, beam // 16)
        # Both the vectors gathered and the marks of nodes seen, one a query and node, are bounded.
        step = max(1, min(GATHER // (expand * layer.shape[1] * self.units.shape[1]), SEEN // len(self.units)))
        if n > step:
            parts = [self._search(at, queries[k : k + step], entry[k : k + step], beam) for k in range(0, n, step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.units)), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        fresh = np.zeros((n, beam), bool)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.einsum("rcd,rd->rc", self.units[ids[:, :width]], queries)
        fresh[:, :width] = True
        seen[rows, ids[:, :width]] = True
        live = np.arange(n)
        while len(live):
            waiting = np.where(fresh[live], sims[live], -np.inf)
            picked = np.argsort(-waiting, axis=1, kind="stable")[:, :expand] if expand > 1 else waiting.argmax(axis=1)[:, None]
            good = np.isfinite(np.take_along_axis(waiting, picked, 1))
            on = good.any(axis=1)
            live, picked, good = live[on], picked[on], good[on]
            if not len(live):
                break
            fresh[live[:, None], picked] = False
            near = layer[np.where(good, ids[live[:, None], picked], 0)].astype(np.int64)
            near[~good] = -1
            near = near.reshape(len(live), -1)
            new = (near >= 0) & ~seen[live[:, None], near]
            near[~new] = -1
            if expand > 1:
                # The same node may be a neighbour of several that are expanded together.
                order = np.argsort(near, axis=1, kind="stable")
                ordered = np.take_along_axis(near, order, 1)
                twice = np.zeros_like(new)
                np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                new &= ~twice
                near[~new] = -1
            spots = np.nonzero(new)
            seen[live[spots[0]], near[spots]] = True
            found = np.full(near.shape, -np.inf, np.float32)
            found[spots] = np.einsum("pd,pd->p", self.units[near[spots]], queries[live[spots[0]]])
            every_ids = np.concatenate([ids[live], near], axis=1)
            every_sims = np.concatenate([sims[live], found], axis=1)
            every_fresh = np.concatenate([fresh[live], new], axis=1)
            top = np.argpartition(-every_sims, beam - 1, axis=1)[:, :beam] if every_sims.shape[1] > beam else np.arange(beam)[None].repeat(len(live), 0)
            ids[live], sims[live] = np.take_along_axis(every_ids, top, 1), np.take_along_axis(every_sims, top, 1)
            fresh[live] = np.take_along_axis(every_fresh, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, queries: np.ndarray, beam: int, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) candidates of cosine at least ``least``; own: the queries' nodes, if they are of this graph."""
        entry = np.zeros((len(queries), 1), np.int64)
        for at in range(len(self.layers) - 1, 0, -1):
            entry = self._search(at, queries, entry, 1)[0]
        if own is not None:
            entry = np.stack([entry[:, 0], np.where(own == entry[:, 0], (own + 1) % len(self.units), own)], axis=1)
        ids, sims = self._search(0, queries, entry, beam)
        hits = np.nonzero(sims >= least)
        return hits[0], ids[hits]


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaling first keeps very large and small ones exact."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _completed(queries: Rows, nodes: Rows, left: np.ndarray, right: np.ndarray, min_cosine: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """All links inside the components that the found links make, by exact cosine in blocks."""
    shift = 0 if own else len(queries)
    root = _roots(len(nodes) + shift, left, right + shift)
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.diff(root[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        members = order[start : start + size]
        mine = members if own else members[members < shift]
        theirs = members if own else members[members >= shift] - shift
        found = _blockwise(queries[mine], nodes[theirs], min_cosine)
        lefts.append(mine[found[0]])
        rights.append(theirs[found[1]])
    return np.concatenate(lefts), np.concatenate(rights)


def _some(places: np.ndarray, most: int) -> np.ndarray:
    return places[np.linspace(0, len(places) - 1, min(len(places), most)).astype(int)]


def verified_links(queries: Rows, graph: Graph, nodes: Rows, min_cosine: float, own: bool, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(query, node) pairs of cosine at least min_cosine, the beam with which the audit passed, and its recall.

    own: the queries are the graph's nodes; a node's link with itself is left out.
    """
    n = len(queries)
    spread = _some(np.arange(n), AUDIT)
    while True:
        if beam >= len(nodes):
            left, right = _blockwise(queries, nodes, min_cosine)
        else:
            left, right = graph.near(queries.single, beam, min_cosine - SLACK, np.arange(n) if own else None)
            left, right = _linked(queries, nodes, left, right, np.einsum("pd,pd->p", queries.units[left], nodes.units[right]), min_cosine)
            left, right = _completed(queries, nodes, left, right, min_cosine, own)
        if own:
            apart = left != right
            left, right = left[apart], right[apart]
        if beam >= len(nodes):
            return left, right, beam, 1.0
        degree = np.bincount(left, minlength=n)
        linked = np.flatnonzero(degree)
        sparse, without = np.flatnonzero((degree > 0) & (degree < BEAM)), np.flatnonzero(degree == 0)
        drawn = np.random.default_rng(n).permutation(without)[:AUDIT_UNLINKED]
        audit = np.unique(np.concatenate([spread, _some(linked, AUDIT), _some(sparse, AUDIT_SPARSE), drawn]))
        exact = np.bincount(_blockwise(queries[audit], nodes, min_cosine)[0], minlength=len(audit)) - own
        asked = exact > 0
        recall = float((degree[audit][asked] / exact[asked]).mean()) if asked.any() else 1.0
        if recall >= MIN_RECALL:
            return left, right, beam, recall
        beam = beam * 2 if beam * 2 <= WIDEST else max(beam * 2, len(nodes))


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    size = table.column("size")[0].as_py()
    scaled = exactly_scaled(table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size))
    graph = Graph(Rows(scaled).single)
    return pa.table({
        "label": table.column("label")[:1], "size": table.column("size")[:1], "shard": table.column("shard")[:1], "shards": table.column("shards")[:1],
        "nodes": [table.column("node").to_numpy().tobytes()], "copies": [table.column("copies").to_numpy().tobytes()],
        "vectors": [scaled.tobytes()], "graph": [pickle.dumps((graph.level, graph.layers))],
    })


LINKS = "node long, root long, linked long, label string, size int, shard int, to_shard int, beam int, recall double"


def _link_batches(min_cosine: float, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come ordered by graph, the graph's own row before the blocks that query it; only one graph is held."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph, others, copies, to = None, None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                nodes = np.frombuffer(at["nodes"], np.int64)
                rows = Rows(np.frombuffer(at["vectors"], np.float64).reshape(-1, at["size"]))
                if at["graph"] is not None:
                    key, others, copies, to = (at["label"], at["size"], at["to_shard"]), nodes, np.frombuffer(at["copies"], np.int64), rows
                    graph = Graph.__new__(Graph)
                    graph.units = rows.single
                    graph.level, graph.layers = pickle.loads(at["graph"])
                    continue
                if key != (at["label"], at["size"], at["to_shard"]):
                    raise RuntimeError("queries came without their graph")
                own = at["shard"] == at["to_shard"]
                left, right, width, recall = verified_links(rows, graph, to, min_cosine, own, beam)
                n = len(nodes)
                total = np.bincount(left, copies[right], n).astype(np.int64)
                if own:
                    root = nodes[_roots(n, left, right)]
                else:
                    both = np.concatenate([nodes, others])
                    rooted = _roots(n + len(others), left, n + right)
                    touched = np.unique(n + right)
                    nodes, root = np.concatenate([nodes, both[touched]]), both[np.concatenate([rooted[:n], rooted[touched]])]
                    total = np.concatenate([total, np.zeros(len(touched), np.int64)])
                some = (total > 0) | (root != nodes)
                found = pa.RecordBatch.from_pydict({"node": nodes[some], "root": root[some], "linked": total[some]})
                said = {"label": at["label"], "size": at["size"], "shard": at["shard"], "to_shard": at["to_shard"], "beam": width, "recall": recall}
                yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, _TYPES[c]) for c in said)], [*found.schema.names, *said])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.array([v], _TYPES[c]) for c, v in said.items())], [*found.schema.names, *said])

    return link


_TYPES = {"label": pa.string(), "size": pa.int32(), "shard": pa.int32(), "to_shard": pa.int32(), "beam": pa.int32(), "recall": pa.float64()}


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with label and vector (null where they can't link), and their distinct vectors as numbered nodes."""
    bound_batches(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    fine = F.coalesce(
        F.col("label").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("label").cast("string")).alias("label"), F.when(fine, vector).alias("vector"))
    groups = rows.where(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # Node numbers are those of the materialised rows, so a recomputed task gives the same.
    return rows, cut_lineage(groups).withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector"))


def shard_links(groups: DataFrame, min_cosine: float = MIN_COSINE, shard_floats: int = SHARD_FLOATS, beam: int = BEAM) -> DataFrame:
    """``(node, root, linked)`` of the links of every shard with every shard of its label, and a row of each pair's audit."""
    shards = cut_lineage(groups.groupBy("label", "size").agg(F.ceil(F.count("*") * F.col("size") / shard_floats).cast("int").alias("shards")))
    n_labels, n_tasks = shards.agg(F.count("*"), F.coalesce(F.sum(F.col("shards").cast("long") * F.ceil(F.col("shards") / QUERY_SHARDS)), F.lit(0))).first()
    dealt = groups.join(F.broadcast(shards) if n_labels <= BROADCAST_LABELS else shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    schema = "label string, size int, shard int, shards int, nodes binary, copies binary, vectors binary, graph binary"
    built = cut_lineage(dealt.select("label", "size", "shard", "shards", "node", "copies", "vector").groupBy("label", "size", "shard").applyInArrow(_build, schema))
    last = F.col("shards") - 1
    columns = ("label", "size", "to_shard", "part", "shard", "nodes", "copies", "vectors", "graph")
    graphs = built.withColumn("to_shard", F.col("shard")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(last / QUERY_SHARDS).cast("int")))).withColumn("shard", F.lit(-1)).select(*columns)
    part = F.floor(F.col("shard") / QUERY_SHARDS).cast("int")
    queries = built.withColumn("to_shard", F.explode(F.sequence(F.lit(0), last))).withColumn("part", part)
    queries = queries.withColumn("copies", F.lit(None).cast("binary")).withColumn("graph", F.lit(None).cast("binary")).select(*columns)
    key = ["label", "size", "to_shard", "part"]
    ordered = graphs.union(queries).repartition(max(1, min(n_tasks, 8192)), *key).sortWithinPartitions(*key, "shard")
    return cut_lineage(ordered.mapInArrow(_link_batches(min_cosine, beam), LINKS))


def audits(vectors: DataFrame, min_cosine: float = MIN_COSINE, shard_floats: int = SHARD_FLOATS, beam: int = BEAM) -> DataFrame:
    """``(label, size, shard, to_shard, beam, recall)``: with what beam and recall each shard's queries of another passed."""
    return shard_links(_nodes(vectors)[1], min_cosine, shard_floats, beam).where("beam IS NOT NULL").select("label", "size", "shard", "to_shard", "beam", "recall")


def embedding_components(vectors: DataFrame, min_cosine: float = MIN_COSINE, shard_floats: int = SHARD_FLOATS, beam: int = BEAM) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of vectors (vec_id, embedding, label)."""
    rows, groups = _nodes(vectors)
    links = shard_links(groups, min_cosine, shard_floats, beam).where("node IS NOT NULL").select("node", "root", "linked")
    degrees = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    rooted = connected_components(links, "node", "root").withColumnRenamed("root", "component").withColumnRenamed("node", "member")
    of = groups.select("node", "label", "vector", "first_id", "copies").join(degrees, "node", "left").join(rooted, F.col("node") == F.col("member"), "left")
    of = cut_lineage(of.withColumn("component", F.coalesce("component", "node")))
    names = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    total = of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    of = of.join(names, "component").select(F.col("label").alias("of"), F.col("vector").alias("is"), "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "copies")
    # Fewer than HEAVY_PARTS vectors can each have more than that part of the rows; theirs need no shuffle.
    is_heavy = F.col("copies") > total // HEAVY_PARTS + 1
    heavy, light = F.broadcast(of.where(is_heavy).drop("copies")), of.where(~is_heavy).drop("copies")
    same = (F.col("label") == F.col("of")) & (F.col("vector") == F.col("is"))
    rest = rows.where(F.col("vector").isNotNull()).join(heavy.select("of", "is"), same, "left_anti")
    alone = rows.where(F.col("vector").isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in light.schema))
    out = rows.join(heavy, same).unionByName(rest.join(light, same)).unionByName(alone)
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
