"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class. Classes are dealt to shards by hash; a task builds its shard's graph and streams all
vectors past it as queries, in batches. Beams start narrow. A beam full of partners is widened once for
its query; a query that is full again, or would need a tenth of the shard, is compared with the whole shard as a matrix
product, in blocks, as a graph is slower than that where near groups are dense. A batch whose recall audit fails (members of the
shard that do not find themselves, or sampled queries that miss a partner found by brute force) is searched again with
wider beams, which are halved again after some batches without need. Partners are verified in double precision; components come from the
verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.components import components
from paylens.llm.tables import col
from paylens.session import stored

COSINE = 0.95
# vectors of one shard, about; a graph of so many with 64 dimensions takes some 200 MB
SHARD = 100_000
LEAST_SHARDS = 8
LINKS = 12
BUILD_BEAM = 40
BEAM = 16
BATCH = 512
AUDIT_ONE_IN = 16
RECALL = 0.99
# float32 sums may be off by this much
SLACK = 1e-4
# batches after which a widened beam is halved again
CALM = 8
# a beam of one in so many of the shard is no better than a matrix product
DENSE = 10
# members compared at once, pairs verified at once
MEMBERS, PIECE = 8192, 1 << 16


class Graph:
    """A navigable small-world graph over unit vectors; all searches run on batches of queries."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.x, self.links = np.ascontiguousarray(unit, dtype=np.float32), links
        n = len(unit)
        draw = np.random.default_rng(n).random(n)
        self.level = np.minimum((-np.log(1 - draw) / np.log(links)).astype(np.int64), 12)
        # insertion begins at a top node, so that every level has its entry
        order = np.argsort(-self.level, kind="stable")[:1]
        order = np.concatenate([order, np.setdiff1d(np.arange(n), order)])
        top = int(self.level.max(initial=0))
        self.edges = [np.full((n, links * (2 if l == 0 else 1)), -1, dtype=np.int32) for l in range(top + 1)] if n else []
        self.entry, self.top = (int(order[0]), top) if n else (-1, -1)
        done = 1
        while done < n:
            step = min(done, BATCH, n - done)
            self._insert(order[done : done + step], beam)
            done += step

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        start = np.full((len(nodes), 1), self.entry)
        for level in range(self.top, -1, -1):
            here = self.level[nodes] >= level
            ids, _ = self._beam(self.x[nodes], start, level, beam if here.any() else 1)
            start = ids[:, :1]
            if not here.any():
                continue
            new = nodes[here]
            # members of the batch are candidates for each other
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -2)
            k = min(len(new) - 1, self.links)
            peers = new[np.argpartition(-near, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(new), 0), dtype=np.int64)
            candidates = np.concatenate([ids[here], peers], axis=1)
            chosen = self._select(new, candidates, self.links)
            self.edges[level][new, : self.links] = chosen
            self._link_back(new, chosen, level)

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Nearest candidates that are nearer to the node than to any chosen before; the nearest others fill up."""
        c = np.where(candidates == nodes[:, None], -1, candidates)
        sims = np.einsum("bd,bcd->bc", self.x[nodes], self.x[c])
        sims[c < 0] = -2
        order = np.argsort(-sims, axis=1, kind="stable")
        c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
        twice = np.zeros(c.shape, dtype=bool)
        twice[:, 1:] = (c[:, 1:] == c[:, :-1]) & (c[:, 1:] >= 0)
        vectors = self.x[c]
        among = np.matmul(vectors, vectors.transpose(0, 2, 1))
        closest = np.full(c.shape, -2.0, dtype=np.float32)
        chosen = np.zeros(c.shape, dtype=bool)
        count = np.zeros(len(c), dtype=np.int64)
        for j in range(c.shape[1]):
            take = (c[:, j] >= 0) & ~twice[:, j] & (sims[:, j] > closest[:, j]) & (count < most)
            chosen[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, among[:, :, j]), closest)
        rank = np.where(chosen, 0, np.where((c < 0) | twice, 2, 1))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(rank == 2, -1, c), pick, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
        return out

    def _link_back(self, new: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Add the reverse of new edges; a node with too many chooses again."""
        table = self.edges[level]
        to, by = chosen.reshape(-1), np.repeat(new, chosen.shape[1])
        by, to = by[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        nodes, first, sizes = np.unique(to[order], return_index=True, return_counts=True)
        by, width, most = by[order], table.shape[1], int(sizes.max(initial=0))
        for a in range(0, len(nodes), BATCH):
            part = slice(a, a + BATCH)
            extra = np.full((len(nodes[part]), most), -1, dtype=np.int64)
            for i, (f, s) in enumerate(zip(first[part], sizes[part])):
                extra[i, :s] = by[f : f + s]
            # the whole batch may point at one node: only its nearest matter
            both = np.concatenate([table[nodes[part]], extra], axis=1)
            if both.shape[1] > 2 * width:
                sims = np.einsum("bd,bcd->bc", self.x[nodes[part]], self.x[both])
                sims[both < 0] = -2
                both = np.take_along_axis(both, np.argpartition(-sims, 2 * width, axis=1)[:, : 2 * width], 1)
            table[nodes[part]] = self._select(nodes[part], both, width)

    def _beam(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes of each query, best first; -1 where there are fewer."""
        n, table = len(queries), self.edges[level]
        ids = np.full((n, beam), -1, dtype=np.int64)
        sims = np.full((n, beam), -2.0, dtype=np.float32)
        opened = np.ones((n, beam), dtype=bool)
        k = min(beam, start.shape[1])
        ids[:, :k], opened[:, :k] = start[:, :k], start[:, :k] < 0
        sims[:, :k] = np.where(start[:, :k] >= 0, np.einsum("bd,bkd->bk", queries, self.x[start[:, :k]]), -2)
        seen = np.zeros((n, len(self.x) + 1), dtype=bool)
        seen[np.arange(n)[:, None], ids] = True
        live = np.arange(n)
        while len(live):
            waiting = np.where(opened[live], -3.0, sims[live])
            best = np.argpartition(-waiting, min(expand, beam) - 1, axis=1)[:, :expand] if beam > 1 else np.zeros((len(live), 1), dtype=np.int64)
            use = np.take_along_axis(waiting, best, 1) > -3
            keep = use.any(axis=1)
            live, best, use = live[keep], best[keep], use[keep]
            if not len(live):
                break
            nodes = np.where(use, ids[live[:, None], best], -1)
            mine = opened[live]
            np.put_along_axis(mine, best, True, 1)
            opened[live] = mine
            found = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(live), -1)
            found.sort(axis=1)
            fresh = found >= 0
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            fresh &= ~seen[live[:, None], found]
            seen[live[:, None], found] = True
            near = np.full(found.shape, -2.0, dtype=np.float32)
            r, c = np.nonzero(fresh)
            near[r, c] = np.einsum("nd,nd->n", queries[live[r]], self.x[found[r, c]])
            s = np.concatenate([sims[live], near], axis=1)
            i = np.concatenate([ids[live], np.where(fresh, found, -1)], axis=1)
            o = np.concatenate([opened[live], ~fresh], axis=1)
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(v, top, 1) for v in (i, s, o))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(queries), 1), self.entry)
        for level in range(self.top, 0, -1):
            start = self._beam(queries, start, level, 1)[0]
        return self._beam(queries, start, 0, min(beam, len(self.x)))


def partners(graph: Graph, queries: np.ndarray, own: np.ndarray, audit: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, ...]:
    """Query, node and similarity of pairs about at or above `least`; the queries that a graph is no help for; and the beam that passed the audit.

    `own` gives the node that a query is itself, -1 if it is not of this shard; `audit` marks queries compared by brute force.
    """
    n = len(graph.x)
    looked = np.flatnonzero(audit)
    truth = graph.x @ queries[looked].T >= least + 2 * SLACK if len(looked) else np.zeros((n, 0), dtype=bool)
    while DENSE * beam < n:
        rows, nodes, near, wide = [], [], [], []
        itself = own < 0
        todo, width, last = np.arange(len(queries)), beam, False
        while len(todo):
            ids, sims = graph.search(queries[todo], width)
            itself[todo] |= (ids == own[todo, None]).any(axis=1)
            hit = sims >= least - SLACK
            full = hit.all(axis=1)
            r, c = np.nonzero(hit & ~full[:, None])
            rows.append(todo[r]), nodes.append(ids[r, c]), near.append(sims[r, c])
            todo, width = todo[full], 4 * width
            if last or DENSE * width >= n:
                wide.append(todo)
                break
            last = True
        r, c, s = np.concatenate(rows), np.concatenate(nodes), np.concatenate(near)
        dense = np.concatenate(wide) if wide else np.zeros(0, dtype=np.int64)
        itself[dense] = True
        at = np.searchsorted(looked, r)
        mine = np.append(looked, -1)[at] == r
        found = np.zeros((n, len(looked)), dtype=bool)
        found[c[mine], at[mine]] = True
        found[:, np.isin(looked, dense)] = True
        if itself.mean() >= RECALL and (truth & ~found).sum() <= (1 - RECALL) * truth.sum():
            # the few that did not find themselves are compared in full
            late = np.flatnonzero(~itself)
            rest = ~np.isin(r, late)
            return r[rest], c[rest], s[rest], np.concatenate([dense, late]), beam
        beam *= 2
    none = np.zeros(0, dtype=np.int64)
    return none, none, np.zeros(0, dtype=np.float32), np.arange(len(queries)), beam


class _Shard:
    """One shard: members arrive first, then all vectors as queries."""

    def __init__(self, least: float):
        self.least, self.beam, self.calm = least, BEAM, 0
        self.node, self.raw, self.copies = [], [], []
        self.graph: Graph | None = None

    def build(self) -> None:
        self.node, self.copies = np.concatenate(self.node), np.concatenate(self.copies)
        self.raw = np.concatenate(self.raw)
        self.norm = np.linalg.norm(self.raw.astype(np.float64), axis=1)
        self.graph = Graph(self.raw / self.norm[:, None])
        self.order = np.argsort(self.node)
        # members that are linked inside the shard, by their least member
        self.root = np.arange(len(self.node))
        for a in range(0, len(self.node), BATCH):
            part = np.arange(a, min(a + BATCH, len(self.node)))
            for r, c in self.verified(self.node[part], self.raw[part]):
                cut = np.flatnonzero(np.diff(r)) + 1
                for x, members in zip(part[r[np.append(0, cut)]].tolist() if len(r) else [], np.split(c, cut)):
                    # most members of a dense group have one root after its first query
                    for y in np.unique(self._roots(members)).tolist():
                        self._join(x, y)
        self.root = self._roots(np.arange(len(self.root)))

    def _roots(self, members: np.ndarray) -> np.ndarray:
        at = self.root[members]
        while (self.root[at] != at).any():
            at = self.root[at]
        return at

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _join(self, a: int, b: int) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def verified(self, node: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs at or above the limit in double precision, without the query itself, in order of the query per piece."""
        norm = np.linalg.norm(raw.astype(np.float64), axis=1)
        at = np.minimum(np.searchsorted(self.node, node, sorter=self.order), len(self.node) - 1)
        own = np.where(self.node[self.order[at]] == node, self.order[at], -1)
        # a fixed part of all queries, told by their number
        audit = (node * np.int64(2654435761) >> np.int64(16)) % AUDIT_ONE_IN == 0
        unit = (raw / norm[:, None]).astype(np.float32)

        def sure(r: np.ndarray, c: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            stay = own[r] != c
            doubt = np.flatnonzero(stay & (np.abs(sims - self.least) <= SLACK))
            stay &= sims >= self.least
            for k in range(0, len(doubt), PIECE):
                d = doubt[k : k + PIECE]
                exact = np.einsum("nd,nd->n", raw[r[d]].astype(np.float64), self.raw[c[d]].astype(np.float64)) / (norm[r[d]] * self.norm[c[d]])
                stay[d] = exact >= self.least
            return r[stay], c[stay]

        r, c, sims, wide, passed = partners(self.graph, unit, own, audit, self.least, self.beam)
        # what one batch needed is not carried on for good
        self.calm = 0 if passed > self.beam else self.calm + 1
        self.beam = passed
        if self.calm == CALM:
            self.beam, self.calm = max(BEAM, passed // 2), 0
        order = np.argsort(r, kind="stable")
        yield sure(r[order], c[order], sims[order])
        for a in range(0, len(self.node), MEMBERS) if len(wide) else []:
            close = unit[wide] @ self.graph.x[a : a + MEMBERS].T
            r, c = np.nonzero(close >= self.least - SLACK)
            yield sure(wide[r], c + a, close[r, c])

    def answer(self, node: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, number of linked vectors, and one member of each linked group of members, as rows."""
        links, seen = np.zeros(len(node), dtype=np.int64), []
        for r, c in self.verified(node, raw):
            links += np.bincount(r, weights=self.copies[c], minlength=len(node)).astype(np.int64)
            # members linked to each other are one group; one link to each group joins all that the query links
            seen.append(np.unique(r * len(self.node) + self.root[c]))
        pair = np.unique(np.concatenate(seen))
        query, root = pair // len(self.node), pair % len(self.node)
        count = np.zeros(len(pair), dtype=np.int64)
        hit = np.flatnonzero(links)
        count[np.searchsorted(query, hit)] = links[hit]
        return node[query], count, self.node[root]


def _shards(least: float):
    """Rows (part, kind, node, copies, v) in order of (part, kind) to (node, links, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = None, None
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if parts[a] != part:
                    part, shard = parts[a], _Shard(least)
                node = rows.column("node").to_numpy()
                raw = rows.column("v").flatten().to_numpy().reshape(b - a, -1)
                if kinds[a] == 0:
                    shard.node.append(node), shard.raw.append(raw), shard.copies.append(rows.column("copies").to_numpy())
                    continue
                if shard.graph is None:
                    if not shard.node:
                        continue
                    shard.build()
                for i in range(0, b - a, BATCH):
                    got = shard.answer(node[i : i + BATCH], raw[i : i + BATCH])
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["node", "links", "other"])

    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE, shard: int = SHARD, least_shards: int = LEAST_SHARDS
) -> DataFrame:
    """(id, n_links, component_id): one row per row of `rows`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different length do not link with each other; a row without links is its own component. Rows with the same vector are
    linked, whatever their number. A null key is passed over when the least is taken. A shard has about `shard` classes,
    and there are at least `least_shards`.
    """
    v = col(vector).cast("array<double>")
    usable = (
        col(vector).isNotNull()
        & (F.size(col(vector)) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    # minus zero equals zero
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    base = rows.select(col(key).alias("id"), F.when(F.coalesce(usable, F.lit(False)), plain).alias("v"))
    classes = stored(
        base.where("v IS NOT NULL")
        .groupBy("v")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    n = classes.count()
    shards = max(least_shards, -(-n // shard))
    home = F.pmod(F.xxhash64("node"), F.lit(shards))
    # as a member of its own shard, and as a query to each shard of its length
    visits = F.concat(
        F.array(F.struct(home.cast("long").alias("s"), F.lit(0).alias("kind"))),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.cast("long").alias("s"), F.lit(1).alias("kind"))),
    )
    dealt = classes.select("node", "copies", "v", F.explode(visits).alias("x")).select(
        (F.size("v") * shards + F.col("x.s")).cast("long").alias("part"), F.col("x.kind").alias("kind"), "node", "copies", "v"
    )
    # each shard of a length has a partition of its own
    placed = dealt.repartitionById(shards, F.pmod(F.col("part"), F.lit(shards)).cast("int")).sortWithinPartitions("part", "kind", "node")
    found = stored(placed.mapInArrow(_shards(least), "node long, links long, other long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = (
        classes.join(counted, "node", "left")
        .join(roots, "node", "left")
        .select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    least_id = member.groupBy("root").agg(F.min("first").alias("component_id"))
    known = member.join(least_id, "root").select(F.col("v").alias("v2"), "n_links", "component_id")
    return base.join(known, F.col("v") == F.col("v2"), "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
