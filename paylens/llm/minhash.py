"""Near duplicates by minhash with tensored banding.

Two collections of HALVES half-keys are computed, each half-key made of HALF minhashes. A table key is one
half-key of the first collection with one of the second: HALVES ** 2 tables from 2 * HALVES * HALF minhashes. At a
similarity of s a pair meets in some table with probability (1 - (1 - s ** HALF) ** HALVES) ** 2: 0.9995 at 0.85 with
the settings here. Documents with the same shingles are one class from the start. In each table a class is
checked against the table's central class. Families of a centre that are then still of several components are coded by
their differences from the centre. Families of up to HELD sets are compared in one place by counting shared differences. In
larger ones only sets that share one of their rarest differences are compared, which loses no
similar pair and gives no pairs where a template's copies differ each in its own way. All checks are on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.llm.components import components
from paylens.llm.hashing import blocks, mix64, seeds, shingle_sets
from paylens.llm.tables import col, fresh, small_batches
from paylens.session import stored

SHINGLE = 5
PERCENT = 85
HALVES = 9
HALF = 3
# pairs a set that a shared difference may give at once
FEW = 16
# sets and differences of a family that is compared in one place; larger families are spread over their differences
HELD = 1024
HELD_DIFFERENCES = 1 << 17
# differences of more sets than this are counted by a matrix product, others pair by pair
_DENSE = 32


def _names(halves: int) -> list[str]:
    return [f"{side}{i}" for side in "ab" for i in range(halves)]


def _sketch(width: int, halves: int, half: int):
    """Rows (id, th, text) to (id, th, n, d1, d2, half-keys)."""
    n_hashes = 2 * halves * half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = seeds(n_hashes, 41), seeds(n_hashes, 42)
        weight, spread = seeds(1, 43)[0], seeds(half, 44)
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for _, data, offsets in blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                n.append(sizes)
                full = sizes > 0
                flat = np.concatenate([s for s in sets if len(s)] or [np.zeros(0, dtype=np.uint64)])
                at = (np.cumsum(sizes) - sizes)[full]
                least = np.zeros((n_hashes, len(sets)), dtype=np.uint64)
                digest = np.zeros((2, len(sets)), dtype=np.uint64)
                if len(flat):
                    for i in range(n_hashes):
                        least[i, full] = np.minimum.reduceat(flat * factor[i] + shift[i], at)
                    digest[0, full] = np.add.reduceat(flat, at)
                    digest[1, full] = np.add.reduceat(mix64(flat * weight), at)
                grouped = least.reshape(2 * halves, half, -1)
                keys.append(mix64((mix64(grouped) * spread[None, :, None]).sum(axis=1, dtype=np.uint64)))
                d1.append(digest[0]), d2.append(digest[1])
            if not n:
                continue
            key = np.concatenate(keys, axis=1).view(np.int64)
            columns = [batch.column("id"), batch.column("th"), np.concatenate(n), np.concatenate(d1).view(np.int64), np.concatenate(d2).view(np.int64), *key]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["id", "th", "n", "d1", "d2", *_names(halves)])

    return run


def _sets(width: int):
    """Rows (node, text) to (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in blocks(batch.column("text")):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(row, len(sets)), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "set"]
                )

    return run


def _confirm(percent: int):
    """Rows (a, b, sa, sb) to the pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            keep = []
            lv, rv, lo, ro = left.values.to_numpy(), right.values.to_numpy(), left.offsets.to_numpy(), right.offsets.to_numpy()
            for i in range(len(batch)):
                both = np.concatenate([lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes joined to both sets; AQE splits a node with many partners."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")


_GONE = np.uint64(0x5DEECE66D1234567)


def _differences(percent: int):
    """Rows (g, node, root, sc, s) to (g, node, root, f, b, d, e): a set as what it lacks of the centre's set sc and what it has besides.

    d elements, f = 100 lacking + percent besides, b = (100 - percent) of the centre's size. Elements that are lacking have other codes than
    elements besides. The centre itself is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, own = batch.column("sc"), batch.column("s")
            cv, ov, co, oo = centre.values.to_numpy().view(np.uint64), own.values.to_numpy().view(np.uint64), centre.offsets.to_numpy(), own.offsets.to_numpy()
            out, take, f, b = [], [], [], []
            for i in range(len(batch)):
                c, x = cv[co[i] : co[i + 1]], ov[oo[i] : oo[i + 1]]
                lacking, besides = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
                if len(lacking) + len(besides):
                    out.append(np.concatenate([mix64(lacking ^ _GONE), besides]).view(np.int64))
                    take.append(i), f.append(100 * len(lacking) + percent * len(besides)), b.append((100 - percent) * len(c))
            kept = [batch.column(n).take(pa.array(take, type=pa.int64())) for n in ("g", "node", "root")]
            d = pa.array([len(x) for x in out], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(f, type=pa.int64()), pa.array(b, type=pa.int64()), d, pa.array(out, type=pa.list_(pa.int64()))],
                names=["g", "node", "root", "f", "b", "d", "e"],
            )

    return run


def _shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many elements each list shares with each later one; a list holds an element once."""
    n = len(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    _, at, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    dense = np.flatnonzero(df > _DENSE)
    place = np.full(len(df), -1)
    place[dense] = np.arange(len(dense))
    use = place[at] >= 0
    table = np.zeros((n, len(dense)), dtype=np.float32)
    table[row[use], place[at[use]]] = 1
    count = np.triu(table @ table.T, 1)
    use = (df[at] > 1) & ~use
    order = np.argsort(at[use], kind="stable")
    at, row = at[use][order], row[use][order]
    for apart in range(1, _DENSE):
        both = np.flatnonzero(at[apart:] == at[:-apart])
        if not len(both):
            break
        np.add.at(count, (row[both], row[both + apart]), 1)
    return count


def _family_links(percent: int):
    """Rows (b, members [(node, root, f, e)]), a family each, to pairs (a, b) that join its similar sets, one less than they are at most."""

    def links(b: int, node: np.ndarray, root: np.ndarray, f: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        similar = (100 + percent) * _shared_counts(lists).astype(np.int64) >= np.maximum(f[:, None] + f[None, :] - b, 1)
        similar = np.triu(similar, 1)
        similar |= similar.T
        first = {int(r): np.flatnonzero(root == r) for r in np.unique(root)}
        reached = np.zeros(len(node), dtype=bool)
        for r in first:
            if reached[first[r][0]]:
                continue
            reached[first[r]] = True
            ahead = first[r].tolist()
            while ahead:
                x = ahead.pop()
                new = np.flatnonzero(similar[x] & ~reached)
                for y in new[np.unique(root[new], return_index=True)[1]].tolist():
                    yield int(node[x]), int(node[y])
                    joined = first[int(root[y])]
                    reached[joined] = True
                    ahead += joined.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                members = batch.column("members").slice(i, 1).flatten()
                node, root, f = (members.field(c).to_numpy() for c in ("node", "root", "f"))
                lists = [members.field("e")[j].values.to_numpy() for j in range(len(members))]
                out += links(b, node, root, f, lists)
            pairs = np.sort(np.array(out, dtype=np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _family_pairs(members: DataFrame, sets: DataFrame, percent: int, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) that may be similar inside families (g, centre, node, root), and families for the rest (the same columns), if any.

    Each set is coded by its difference from the centre, with which all members have been compared. Let f and b be as in
    _differences: sets x and y are similar if they share (f(x) + f(y) - b) / (100 + percent) differences. Families with few members and
    differences are compared in one place.
    """
    of = sets.select(F.col("node").alias("n2"), F.col("set").alias("s"))
    centre = sets.select(F.col("node").alias("centre"), F.col("set").alias("sc"))
    coded = members.join(of, F.col("node") == F.col("n2")).join(centre, "centre").select("g", "node", "root", "sc", "s")
    coded = stored(coded.mapInArrow(_differences(percent), "g long, node long, root long, f long, b long, d long, e array<long>"))
    large = coded.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("d").alias("ds"))
    large = stored(large.where(f"k > {HELD} OR ds > {HELD_DIFFERENCES}").select("g"))
    held = coded.join(large, "g", "left_anti").groupBy("g").agg(F.first("b").alias("b"), F.collect_list(F.struct("node", "root", "f", "e")).alias("members"))
    with small_batches(members.sparkSession):
        pairs = stored(held.select("b", "members").mapInArrow(_family_links(percent), "a long, b long").distinct())
    if large.isEmpty():
        return pairs, None
    more, families = _spread_pairs(coded.join(large, "g", "left_semi"), percent, small)
    return pairs.union(more).distinct(), families


def _spread_pairs(coded: DataFrame, percent: int, small: int) -> tuple[DataFrame, DataFrame]:
    """The same for families (g, node, root, f, b, d, e) of any size, by joins.

    Sets x and y need (f(x) + f(y) - b) / (100 + percent) shared differences. Where they share none they are
    similar only if both are similar to the centre, and then they are joined already. Other pairs meet at one of their rarest
    differences: with y the one of larger f, both must have one of their first d - need + 1 in common. The need follows from both f, so
    sets are filed under their own class of f and looked for under each class that a partner may have. Differences of one
    component only join nothing.
    A difference that joins more than `small` pairs a set becomes a family of its own, with a centre out of it.
    """
    each = coded.select("g", "node", "root", "f", "b", "d", F.explode("e").alias("e"))
    known = each.groupBy(F.col("g").alias("g2"), F.col("e").alias("e2")).agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    known = stored(known.where("lo < hi").select("g2", "e2", "df"))
    shared = each.join(known, (F.col("g") == F.col("g2")) & (F.col("e") == F.col("e2")))
    mine = W.partitionBy("g", "node")
    # differences of one component come first and join nothing
    ranked = shared.withColumn("at", F.col("d") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "e")))
    need = f"greatest(CAST(ceil(({{}} - b) / {100 + percent}) AS BIGINT), 1L)".format
    width = "greatest(b DIV 2, 100L)"
    # a partner's f is at least percent / 100 of (f - b)
    least = f"greatest((f - b) * {percent} DIV 100, 0L) DIV {width}"
    # sets of f up to b are similar to the centre, so joined to each other: the larger f of a pair is above b
    filed = F.expr(f"array(named_struct('k', f DIV {width}, 'side', 0, 'need', {need('f + greatest(f, b)')}))")
    classes = f"transform(sequence({least}, f DIV {width}), j -> named_struct('k', j, 'side', 1, 'need', {need(f'f + j * {width}')}))"
    sought = F.expr(f"filter({classes}, p -> f > b)")
    placed = ranked.select("g", "node", "root", "f", "b", "d", "e", "at", F.explode(F.concat(filed, sought)).alias("p"))
    placed = stored(placed.where("at <= d - p.need + 1").select("g", "node", "root", "f", "b", "d", "e", "at", "p.k", "p.side"))
    key = ["g", "e", "k"]
    size = placed.groupBy(*key).agg(
        F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("f", "node")).alias("c")
    )
    size = stored(size.where("lo < hi AND n0 > 0 AND n1 > 0").select(*key, F.expr(f"n0 * n1 > {small} * (n0 + n1)").alias("many"), F.col("c.node").alias("centre")))
    few = size.where("NOT many").select(*key)
    x = placed.where("side = 0").join(few, key, "left_semi").select(*key, "b", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("f").alias("fa"), F.expr("d - at").alias("left_a"))
    y = placed.where("side = 1").join(few, key, "left_semi").select(*key, F.col("node").alias("b_"), F.col("root").alias("rb"), F.col("f").alias("fb"), F.expr("d - at").alias("left_b"))
    enough = F.expr(f"1 + least(left_a, left_b) >= {need('fa + fb')}")
    pairs = x.join(y, key).where((F.struct("fa", "a") < F.struct(F.col("fb").alias("fa"), F.col("b_").alias("a"))) & (F.col("ra") != F.col("rb")) & enough)
    pairs = pairs.select(F.least("a", "b_").alias("a"), F.greatest("a", "b_").alias("b")).distinct()
    families = placed.join(size.where("many").select(*key, "centre"), key).select(F.xxhash64(*key).alias("g"), "centre", "node", "root").distinct()
    return pairs, families


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links between nodes, which are joined by the roots they have."""
    ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    joined = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).toDF("old", "new")
    alone = joined.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).union(alone)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    percent: int = PERCENT,
    halves: int = HALVES,
    half: int = HALF,
) -> DataFrame:
    """(id, th, n_shingles, component_id): one row per row of `docs`.

    `id` is the key, `th` the xxhash64 of the text, to tell rows with the same key apart. component_id is the least
    key that links reach. Documents without words, null texts among them, are linked with nothing and are their own
    component. A null key is passed over when the least is taken, and is null only if all of a component are. Any
    number of rows may be copies of each other: they become one class by an aggregate.
    """
    source = docs.select(col(key).alias("id"), F.xxhash64(col(text)).alias("th"), col(text).cast("binary").alias("text"))
    names = _names(halves)
    kind = docs.select(col(key)).dtypes[0][1]
    schema = f"id {kind}, th long, n long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in names)
    base = stored(source.mapInArrow(_sketch(width, halves, half), schema))
    # the class's texts all have the same shingles: any of them can stand for it
    classes = stored(
        base.where("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("id", "th")).alias("one"), F.min("id").alias("first"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in names])
        .withColumn("node", F.monotonically_increasing_id())
    )

    # only half-keys that two classes share can be part of a shared table key
    halves_of = classes.select("node", F.posexplode(F.array(*names)).alias("at", "v"))
    shared = halves_of.groupBy(F.col("at").alias("at2"), F.col("v").alias("v2")).agg(F.count(F.lit(1)).alias("k"))
    # short lists are stored before a join: it then stands on plain shuffles, whose frequent keys can be split
    shared = stored(shared.where("k > 1"))
    alive = (
        halves_of.join(shared, (F.col("at") == F.col("at2")) & (F.col("v") == F.col("v2")))
        .groupBy("node")
        .agg(F.sum(F.pow(F.lit(2.0), F.col("at")).cast("long")).alias("bits"), F.sum("k").alias("known"))
    )
    first = [F.array(*names[:halves]), F.array(*names[halves:])]
    live = lambda shift: F.filter(F.sequence(F.lit(0), F.lit(halves - 1)), lambda i: F.getbit("bits", i + shift) == 1)
    # a table's key for each live half-key of the first collection with each of the second
    tables = F.flatten(F.transform(live(0), lambda i: F.transform(live(halves), lambda j: F.xxhash64(i, j, F.get("a", i), F.get("b", j)))))
    sided = classes.select("node", *[side.alias(c) for c, side in zip("ab", first)])
    keyed = sided.join(alive, "node").select("node", "known", F.explode(tables).alias("t"))
    # the class that most others share half-keys with stands in the middle of its table
    centre = keyed.groupBy(F.col("t").alias("t2")).agg(F.max(F.struct("known", (-F.col("node")).alias("m"))).alias("c"), F.count(F.lit(1)).alias("k"))
    centre = stored(centre.where("k > 1").select("t2", (-F.col("c.m")).alias("a")))
    met = stored(keyed.join(centre, F.col("t") == F.col("t2")).select("t", "node", "a"))
    starred = stored(met.where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())

    wanted = starred.select(F.col("a").alias("node")).union(starred.select("b")).distinct().join(classes.select("node", "one"), "node")
    wanted = wanted.select("node", F.col("one.id").alias("id2"), F.col("one.th").alias("th2"))
    texts = source.join(wanted, col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
    # the chosen row may be in the input more than once
    once = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(once.mapInArrow(_sets(width), "node long, set array<long>"))
    links = stored(_confirmed(starred, sets, percent))
    roots = components(links)

    # families of a centre that the links leave with classes of other components
    families = met.select(F.col("a").alias("g"), F.col("a").alias("centre"), "node").distinct()
    few = FEW
    while True:
        placed = families.join(roots.toDF("node", "known"), "node", "left").select("g", "centre", "node", F.coalesce("known", "node").alias("root"))
        # at least two members beside the centre, and two components
        is_open = placed.groupBy(F.col("g").alias("g2")).agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        is_open = stored(is_open.where("k > 2 AND lo < hi").select("g2"))
        if is_open.isEmpty():
            break
        members = stored(placed.join(is_open, F.col("g") == F.col("g2"), "left_semi"))
        pairs, families = _family_pairs(members, sets, percent, few)
        if families is not None:
            families = stored(families)
            stars = families.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
            pairs = pairs.union(stars).distinct()
        links = stored(_confirmed(pairs.join(starred, ["a", "b"], "left_anti"), sets, percent))
        if not links.isEmpty():
            roots = stored(_joined(roots, links))
        if families is None:
            break
        # families of families end soon: the more they are, the more pairs are compared at once
        few *= 8

    member = classes.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), "first")
    least_id = member.groupBy("root").agg(F.min("first").alias("component_id"))
    found = member.join(least_id, "root").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "component_id")
    here = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0)
    return base.join(found, here, "left").select(
        "id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, that with the least key.

    Of equal rows one stays. Rows with a null key stay only where their whole component has none.
    """
    found = near_duplicates(docs, key, text, **options)
    k2, t2, th = fresh(docs, "_id", "_th2", "_th")
    stay = found.where("id <=> component_id").select(F.col("id").alias(k2), F.col("th").alias(t2)).distinct()
    rows = docs.withColumn(th, F.xxhash64(col(text)))
    same = col(key).eqNullSafe(F.col(k2)) & (F.col(th) == F.col(t2))
    # an aggregate, so that any number of equal rows shrinks before the shuffle
    return rows.join(stay, same, "left_semi").dropDuplicates([key, th]).drop(th)
