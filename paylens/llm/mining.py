"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For each cluster the candidates of a block are sorted once by an angular bound: a candidate's
product with any member is at most the product of their lengths times the cosine of its angle to the centre less the widest
angle of a member. Every member walks this one list until the bound of what follows is below its own last result, which certifies
that nothing is missing. Candidates are dealt to slices, anchors to groups; a task holds one group of anchors, of bounded
size, and lets one slice of candidates pass in blocks, so that limits found in earlier blocks end later walks sooner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.tables import col
from paylens.session import stored
from paylens.sources.literals import literal_table

# anchors that centres are fitted on, at most, and bytes of them
SAMPLE = 8192
SAMPLE_BYTES = 16 << 20
# anchors of one cluster, about; centres at most
MEMBERS = 64
CENTRES = 256
# anchors of one group, and rows of one slice, at most; slices at least; rows of one block
GROUP = 16_384
SLICE = 1 << 20
LEAST_SLICES = 12
BLOCK = 16_384
_NONE = np.int64(-(2**63))
_MOST = np.int64(2**63 - 1)


def fit_centres(vectors: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors, by rounds of nearest centre and mean."""
    found = vectors[np.linspace(0, len(vectors) - 1, min(centres, len(vectors))).astype(np.int64)]
    for _ in range(rounds):
        near = np.argmax(vectors @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, near, vectors)
        size = np.linalg.norm(total, axis=1)
        found = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], found)
    return found


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(ends)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, values[ends[rows][:, None] + np.arange(d)[None, :]]


def _assign(centres: dict[int, np.ndarray]):
    """Rows (node, id, label, v) with the cluster of each; 0 where vectors of that length have no centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.zeros(len(batch), dtype=np.int32)
            for rows, x in matrices(batch.column("v")):
                if x.shape[1] in centres:
                    cluster[rows] = np.argmax(x @ centres[x.shape[1]].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], names=[*batch.schema.names, "cluster"])

    return run


def products(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Exact products of vectors of whole numbers, held to 64 bits; the product of two lengths is `length` at most."""
    # every partial sum is a whole number below the product of the lengths
    if length < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if length < 2**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if a.size and b.size else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(exact, int(_NONE) + 1, int(_MOST)).astype(np.int64)


class Lists:
    """Anchors of one group with vectors of one length, and the best rows that each has found for each of its bands.

    A band (lo, hi) takes the `k` highest scores from lo to hi, ties by smaller id, null ids last.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, unknown: np.ndarray, label: np.ndarray, cluster: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.x, self.ids, self.unknown, self.label, self.lo, self.hi, self.k, self.same = x, ids, unknown, label, lo, hi, k, same
        self.norm = np.linalg.norm(x, axis=1)
        shape = (*lo.shape, k)
        self.score = np.full(shape, _NONE)
        self.found, self.null = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
        self.have = np.zeros(lo.shape, dtype=np.int64)
        unit = x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.clusters = []
        for c in np.unique(cluster):
            members = np.flatnonzero(cluster == c)
            centre = unit[members].sum(axis=0)
            size = np.linalg.norm(centre)
            centre = centre / size if size > 0 else unit[members[0]]
            angle = np.arccos(np.clip(unit[members] @ centre, -1, 1))
            angle[self.norm[members] == 0] = 0
            self.clusters.append((members, centre, float(angle.max())))

    def need(self, members: np.ndarray) -> np.ndarray:
        """A row that scores less than this is of no use to the member: its last result where it has all, else the band's end."""
        last = np.where(self.have[members] == self.k, self.score[members, :, -1], self.lo[members])
        last = np.maximum(last, self.lo[members])
        # an empty band wants nothing
        return np.where(self.lo[members] <= self.hi[members], last, _MOST).min(axis=1, initial=_MOST)

    def block(self, x: np.ndarray, ids: np.ndarray, unknown: np.ndarray, label: np.ndarray) -> None:
        norm = np.linalg.norm(x, axis=1)
        mine, theirs = float(self.norm.max(initial=0)), float(norm.max(initial=0))
        length = max(mine * theirs, mine, theirs)
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        for members, centre, widest in self.clusters:
            angle = np.arccos(np.clip(unit @ centre, -1, 1))
            # arc cosines are off by some 1e-8
            bound = norm * (np.cos(np.maximum(angle - widest, 0)) + 1e-7)
            order = np.argsort(-bound)
            if not self.same:
                self._walk(members, order, bound, x, ids, unknown, label, length)
                continue
            # one shared list per label
            mine = label[order]
            for one in np.unique(self.label[members]).tolist():
                self._walk(members[self.label[members] == one], order[mine == one], bound, x, ids, unknown, label, length)

    def _walk(self, live, order, bound, x, ids, unknown, label, length) -> None:
        at, step = 0, 256
        while at < len(order):
            reach = self.norm[live] * bound[order[at]]
            live = live[np.floor(reach + 1e-6 * np.abs(reach) + 1e-3) >= self.need(live)]
            if not len(live):
                return
            rows = order[at : at + step]
            scores = products(self.x[live], x[rows], length)
            if self.same:
                # others of the same label: rows with another id
                use = (ids[rows][None, :] != self.ids[live][:, None]) | unknown[rows][None, :] | self.unknown[live][:, None]
            else:
                use = label[rows][None, :] != self.label[live][:, None]
            for band in range(self.lo.shape[1]):
                self._take(live, band, scores, use, ids[rows], unknown[rows])
            at += step
            step = min(2 * step, 4096)

    def _take(self, live, band, scores, use, ids, unknown) -> None:
        k = self.k
        floor = np.maximum(self.lo[live, band], np.where(self.have[live, band] == k, self.score[live, band, -1], _NONE))
        ok = use & (scores >= floor[:, None]) & (scores <= self.hi[live, band][:, None])
        if ok.sum() > 4 * k * len(live) and scores.shape[1] > k:
            seen = np.where(ok, scores, scores.dtype.type(-(2.0**63)))
            ok &= scores >= np.partition(seen, seen.shape[1] - k, axis=1)[:, -k][:, None]
        r, c = np.nonzero(ok)
        if not len(r):
            return
        some = np.unique(r)
        who = live[some]
        old = np.arange(k)[None, :] < self.have[who, band][:, None]
        owner = np.concatenate([np.repeat(some, old.sum(axis=1)), r])
        score = np.concatenate([self.score[who, band][old], scores[r, c].astype(np.int64)])
        found = np.concatenate([self.found[who, band][old], ids[c]])
        null = np.concatenate([self.null[who, band][old], unknown[c]])
        # complement, as the least whole number has no negative
        order = np.lexsort((found, null, ~score, owner))
        owner, score, found, null = owner[order], score[order], found[order], null[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < k
        to = live[owner[best]]
        self.score[to, band, rank[best]], self.found[to, band, rank[best]], self.null[to, band, rank[best]] = score[best], found[best], null[best]
        self.have[who, band] = np.minimum(np.bincount(np.searchsorted(some, owner), minlength=len(some)), k)


def _search(k: int, same: bool):
    """Rows (part, kind, node, id, label, v, cluster, bands) in order of (part, kind), anchors (kind 0) first, to (node, band, score, id)."""

    def start(held: list[pa.RecordBatch]) -> tuple[pa.Array, list]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        labels = pc.unique(rows.column("label"))
        out = []
        for at, x in matrices(rows.column("v")):
            part = rows.take(pa.array(at))
            ids = part.column("id")
            given = part.column("bands").to_pylist()
            most = max(len(b) for b in given)
            lo, hi = np.full((len(at), most), _MOST), np.full((len(at), most), _NONE)
            for i, bands in enumerate(given):
                for j, b in enumerate(bands):
                    lo[i, j], hi[i, j] = b["lo"], b["hi"]
            code = pc.index_in(part.column("label"), value_set=labels).to_numpy()
            lists = Lists(x, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), code, part.column("cluster").to_numpy(), lo, hi, k, same)
            out.append((x.shape[1], part.column("node"), lists))
        return labels, out

    def send(groups: list) -> Iterator[pa.RecordBatch]:
        for _, node, lists in groups:
            r, band, rank = np.nonzero(np.arange(k)[None, None, :] < lists.have[:, :, None])
            ids = pa.array(lists.found[r, band, rank], mask=lists.null[r, band, rank])
            yield pa.RecordBatch.from_arrays([node.take(pa.array(r)), pa.array(band.astype(np.int32)), pa.array(lists.score[r, band, rank]), ids], names=["node", "band", "score", "id"])

    def feed(held: list[pa.RecordBatch], labels: pa.Array, groups: list) -> None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        code = pc.fill_null(pc.index_in(rows.column("label"), value_set=labels), -1).to_numpy()
        ids = rows.column("id")
        known, unknown = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for at, x in matrices(rows.column("v")):
            for d, _, lists in groups:
                if d == x.shape[1]:
                    lists.block(x, known[at], unknown[at], code[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, labels, groups, anchors, held = None, None, [], [], []
        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    if held:
                        feed(held, labels, groups)
                    yield from send(groups)
                    part, groups, anchors, held = parts[a], [], [], []
                rows = batch.slice(a, b - a)
                if kinds[a] == 0:
                    anchors.append(rows)
                    continue
                if not groups:
                    if not anchors:
                        continue
                    labels, groups = start(anchors)
                held.append(rows)
                if sum(len(h) for h in held) >= BLOCK:
                    feed(held, labels, groups)
                    held = []
        if held:
            feed(held, labels, groups)
        yield from send(groups)

    return run


def _groups(anchors: DataFrame, group: int) -> DataFrame:
    """Anchors with the number of their group: whole clusters, or pieces of a large one, at most about `group` rows together.

    One row per cluster and piece comes to the driver: some hundreds, and one for every `group` anchors.
    """
    sizes = anchors.groupBy("cluster").count().orderBy("cluster").collect()
    table, number, filled = [], 0, 0
    for cluster, rows in sizes:
        pieces = -(-rows // group)
        for piece in range(pieces):
            if filled and filled + rows // pieces > group:
                number, filled = number + 1, 0
            table.append((cluster, pieces, piece, number))
            filled += rows // pieces
    placed = literal_table(anchors.sparkSession, table, "cluster int, pieces int, piece int, g int")
    split = anchors.join(F.broadcast(placed.select("cluster", "pieces").distinct()), "cluster")
    split = split.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).drop("pieces")
    return split.join(F.broadcast(placed.drop("pieces")), ["cluster", "piece"]).drop("piece")


def _best(anchors: DataFrame, rows: DataFrame, groups: int, slices: int, k: int, same: bool) -> DataFrame:
    """(node, band, rank, score, id): for each anchor and band the `k` best rows, from 1."""
    part = (F.col("g") * slices + F.col("s")).cast("int")
    kept = ["id", "label", "v"]
    a = anchors.select("g", "node", *kept, "cluster", "bands", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    b = rows.select(*kept, F.pmod(F.xxhash64("node"), F.lit(slices)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    a = a.select(part.alias("part"), F.lit(0).alias("kind"), "node", *kept, "cluster", "bands")
    b = b.select(part.alias("part"), F.lit(1).alias("kind"), *kept)
    dealt = a.unionByName(b, allowMissingColumns=True).repartitionById(groups * slices, F.col("part")).sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(_search(k, same), "node long, band int, score long, id long")
    order = "row_number() OVER (PARTITION BY node, band ORDER BY score DESC, id IS NULL, id)"
    return found.withColumn("rank", F.expr(order)).where(f"rank <= {k}").select("node", "band", "rank", "score", "id")


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    group: int = GROUP,
    slice_rows: int = SLICE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): negatives close behind each positive of an anchor.

    Components become floor(`scale` x), scores are inner products of these. An anchor's positives are its first
    `positives` other rows of its label, by score and then smaller key. For each positive the first `negatives` rows of other
    labels whose score is from `low` to `high` percent of the positive's are returned; none where the band is empty, as with negative
    scores. Keys are whole numbers; `label` is the column of that name and `is_anchor` keys divisible by 100 unless given.

    Rows whose label or vector is null, or whose vector is empty or has a null or non-finite component, take no part; nor do vectors of
    different length with each other. "Other" rows have another key, so equal rows are no positives of each other; as negatives
    each counts. A row with a null key is no anchor by default and comes last among ties. Scores beyond 64 bits are held at
    their limits.
    """
    v = F.transform(col(vector).cast("array<double>"), lambda x: x * scale)
    usable = col(vector).isNotNull() & (F.size(col(vector)) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor would give 64 bits only; whole doubles reach further
    whole = F.transform(v, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0))
    own = col("label") if label is None else label
    chosen = (col(key) % 100 == 0) if is_anchor is None else is_anchor
    base = rows.select(
        col(key).cast("long").alias("id"), own.cast("string").alias("label"), F.when(usable, whole).alias("v"), F.coalesce(chosen, F.lit(False)).alias("chosen")
    )
    base = stored(base.where("label IS NOT NULL AND v IS NOT NULL").withColumn("node", F.monotonically_increasing_id()))
    n, length = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    anchors = base.where("chosen").drop("chosen")
    most = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * (length or 1))))
    drawn = anchors.orderBy(F.xxhash64("node"), "node").limit(most).select("v").toArrow().column("v")
    total = anchors.count()
    centres = {}
    for _, x in matrices(pa.concat_arrays(drawn.chunks)) if len(drawn) else []:
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0][:, None]
        if len(x):
            centres[x.shape[1]] = fit_centres(x, min(CENTRES, max(1, total // MEMBERS)))
    clustered = anchors.mapInArrow(_assign(centres), "id long, label string, v array<double>, node long, cluster int")
    clustered = stored(_groups(stored(clustered), group))
    groups = (clustered.agg(F.max("g")).first()[0] or 0) + 1
    slices = max(LEAST_SLICES, -(-n // slice_rows))

    every = F.array(F.struct(F.lit(int(_NONE) + 1).cast("long").alias("lo"), F.lit(int(_MOST)).alias("hi")))
    first = stored(_best(clustered.withColumn("bands", every), base, groups, slices, positives, True))
    # lo is 30 % rounded up and hi 90 % rounded down, by quotient and rest, so that no product is too long
    limit = first.selectExpr("node", "rank", "score", "score DIV 100 - CASE WHEN score % 100 < 0 THEN 1 ELSE 0 END AS q").selectExpr("*", "score - 100 * q AS r")
    band = f"named_struct('rank', rank, 'lo', {low} * q + CAST(ceil({low} * r / 100D) AS BIGINT), 'hi', {high} * q + {high} * r DIV 100)"
    bands = limit.groupBy(F.col("node").alias("n2")).agg(F.expr(f"transform(array_sort(collect_list({band})), x -> named_struct('lo', x.lo, 'hi', x.hi))").alias("bands"))
    wanting = clustered.join(bands, F.col("node") == F.col("n2")).drop("n2")
    second = _best(wanting, base, groups, slices, negatives, False)
    mine = first.join(clustered.select(F.col("node").alias("n2"), F.col("id").alias("anchor_id")), F.col("node") == F.col("n2"))
    mine = mine.select("node", (F.col("rank") - 1).alias("band"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mine.join(second.select("node", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["node", "band"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
