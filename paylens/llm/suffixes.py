"""Repeated byte strings by a hash-compared suffix sort.

A string of LENGTH bytes that stands in two places has the same anchor there: the first of its GRAM-byte parts with the least
hash. Runs of string starts with one anchor form a segment. Anchors that occur once cannot belong to a
repeat. Of the others, segments that are equal throughout repeat throughout, which counts alone show; the distinct
segments around one anchor are sorted as suffixes, once to the right and once, reversed, to the left of the
anchor. The sort is a mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
polynomial hashes. Common extensions of neighbours are verified byte by byte. In sorted order, strings that agree in both
directions are runs, and any string whose run holds another segment is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.llm.hashing import STEP, blocks, mix64, prefix_hashes, range_hashes, seeds
from paylens.llm.tables import col
from paylens.session import stored

LENGTH = 200
GRAM = 48
# segments around one anchor that are sorted in one place; more are told apart by the hashes of their strings
SORTED = 4096


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last start, anchor (from the row's begin), anchor hash and digest of all segments of a block."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    prefix = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    gram_hash = mix64(range_hashes(prefix, at, at + gram))
    # the least hash of each window, and in its low bits where it is: the first of equals. The same bits count in
    # every block, so that equal strings have equal anchors; no text has 2 ** 32 bytes
    low = np.uint64((1 << 32) - 1)
    least, span = (gram_hash & ~low) | at.astype(np.uint64), 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][row])
    if not len(start):
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    anchor, row = anchor[start], row[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    lo, hi = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])]
    anchor, row = anchor[first], row[first]
    shape = (anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B1) + (hi - lo).astype(np.uint64)
    digest = mix64(range_hashes(prefix, lo, hi + length) + mix64(shape))
    base = offsets[row]
    return row, lo - base, hi - base, anchor - base, gram_hash[anchor], digest


def _anchor_rows(length: int, gram: int):
    """Rows (id, th, text) to (id, th, j, h, d, c), one for each distinct segment of a text.

    j is the number of its first place among the text's segments, c of how many places it has there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for done, data, offsets in blocks(batch.column("text"), STEP // 2):
                row, _, _, _, h, d = anchors(data, offsets, length, gram)
                j = np.arange(len(row)) - np.searchsorted(row, row)
                # equal segments of a row side by side, the first place first
                order = np.lexsort((d, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (d[order][1:] != d[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = order[new]
                c = np.diff(np.append(np.flatnonzero(new), len(order)))
                take = pa.array(row[first] + done)
                columns = [batch.column("id").take(take), batch.column("th").take(take)]
                columns += [pa.array(x) for x in (j[first].astype(np.int32), h[first].view(np.int64), d[first].view(np.int64), c.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "j", "h", "d", "c"])

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace text by its compressed bytes, null by those of an empty one."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(x.as_py() or b"") for x in batch.column("text")], type=pa.binary())
        yield pa.RecordBatch.from_arrays([packed if c == "text" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def _texts(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for x in column:
        yield unpack.decompress(x.as_py())


def _cut_segments(length: int, gram: int):
    """Rows (id, th, text, want [(j, copies, many)]) to (id, th, lo, left, n, copies, h, many, seg)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            keys = zip(batch.column("id").to_pylist(), batch.column("th").to_pylist())
            for (key, th), text, want in zip(keys, _texts(batch.column("text")), batch.column("want").to_pylist()):
                data = np.frombuffer(text, dtype=np.uint8)
                _, lo, hi, anchor, h, _ = anchors(data, np.array([0, len(data)]), length, gram)
                h = h.view(np.int64)
                for w in want:
                    j = w["j"]
                    a, b = int(lo[j]), int(hi[j])
                    out.append((key, th, a, int(anchor[j]) - a, b - a + 1, w["copies"], int(h[j]), w["many"], text[a : b + length]))
            kinds = [batch.column("id").type, batch.column("th").type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["id", "th", "lo", "left", "n", "copies", "h", "many", "seg"]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return run


def common_extension(data: np.ndarray, prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the suffixes at x and at y agree, `most` at most, by binary search over prefix hashes."""
    agreed = np.zeros(len(x), dtype=np.int64)
    step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
    while step:
        fits = agreed + step <= most
        i, j, k = x[fits] + agreed[fits], y[fits] + agreed[fits], step
        same = range_hashes(prefix, i, i + k) == range_hashes(prefix, j, j + k)
        agreed[np.flatnonzero(fits)[same]] += step
        step >>= 1
    return agreed


def _before(data, prefix, start, length, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a is less than suffix b, and whether it is equal."""
    most = np.minimum(length[a], length[b])
    e = common_extension(data, prefix, start[a], start[b], most)
    last = len(data) - 1
    x = np.where(e < length[a], data[np.minimum(start[a] + e, last)].astype(np.int16), -1)
    y = np.where(e < length[b], data[np.minimum(start[b] + e, last)].astype(np.int16), -1)
    return x < y, x == y


def sort_suffixes(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, bytes), and how far each agrees with the one before it (-1 at a group's begin).

    Groups come sorted. All merges of one width are made at once: each suffix finds its rank in the run beside its own.
    """
    n = len(start)
    order = np.arange(n)
    prefix = prefix_hashes(data)
    begin = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    width = 1
    while n and width < int((end - begin).max()):
        at = np.flatnonzero(end - begin > width)
        inside = at - begin[at]
        base = begin[at] + inside // (2 * width) * (2 * width)
        second = inside // width % 2 == 1
        lo = np.where(second, base, np.minimum(base + width, end[at]))
        hi = np.where(second, base + width, np.minimum(base + 2 * width, end[at]))
        own = at - np.where(second, base + width, base)
        first = lo.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less, equal = _before(data, prefix, start, length, order[mid], order[at[open_]])
            # equal suffixes keep their order: those of the first run come first
            ahead = less | (equal & second[open_])
            lo[open_] = np.where(ahead, mid + 1, lo[open_])
            hi[open_] = np.where(ahead, hi[open_], mid)
        merged = order.copy()
        merged[base + own + (lo - first)] = order[at]
        order = merged
        width *= 2
    agreed = np.full(n, -1, dtype=np.int64)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = order[near - 1], order[near]
    agreed[near] = common_extension(data, prefix, start[a], start[b], np.minimum(length[a], length[b]))
    if not _verified(data, start[a], start[b], agreed[near], np.minimum(length[a], length[b])):
        return _plain_sort(data, start, length, group)
    return order, agreed


def _verified(data: np.ndarray, x: np.ndarray, y: np.ndarray, agreed: np.ndarray, most: np.ndarray) -> bool:
    """Whether the bytes agree as far as the hashes say and no further."""
    begin = np.cumsum(agreed) - agreed
    step = np.arange(int(agreed.sum())) - np.repeat(begin, agreed)
    more = agreed < most
    return bool(
        (data[np.repeat(x, agreed) + step] == data[np.repeat(y, agreed) + step]).all()
        and (data[(x + agreed)[more]] != data[(y + agreed)[more]]).all()
    )


def _plain_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing bytes, for the case that hashes have collided."""
    raw = data.tobytes()
    suffix = [raw[a : a + k] for a, k in zip(start.tolist(), length.tolist())]
    order = np.array(sorted(range(len(suffix)), key=lambda i: (group[i], suffix[i])), dtype=np.int64)
    agreed = np.full(len(order), -1, dtype=np.int64)
    for i in range(1, len(order)):
        if group[order[i]] == group[order[i - 1]]:
            a, b = suffix[order[i - 1]], suffix[order[i]]
            agreed[i] = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return order, agreed


def repeated_starts(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, count: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its `count` string starts begin a string that another segment of the group also has.

    Segment i is data[offsets[i]:offsets[i + 1]], its anchor `left` bytes in. Groups come sorted.
    """
    n = len(left)
    anchor = offsets[:-1] + left
    ranks = []
    for bytes_, start, size in ((data, anchor, offsets[1:] - anchor), (data[::-1], len(data) - anchor, left)):
        order, agreed = sort_suffixes(np.ascontiguousarray(bytes_), start, size, group)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        ranks.append((place, agreed))
    (right_place, right), (left_place, back) = ranks
    out = [np.zeros(c, dtype=bool) for c in count.tolist()]
    flat, base = np.zeros(int(count.sum()), dtype=bool), np.cumsum(count) - count
    for before in range(int((left - count + 1).min(initial=0)), int(left.max(initial=-1)) + 1):
        # strings that begin `before` bytes ahead of the anchor
        have = np.flatnonzero((before <= left) & (before > left - count))
        if len(have) < 2:
            continue
        run_right = np.cumsum(right < length - before)[right_place[have]]
        run_left = np.cumsum(back < before)[left_place[have]]
        _, inverse, times = np.unique(run_right * (n + 1) + run_left, return_inverse=True, return_counts=True)
        twice = have[times[inverse] > 1]
        flat[base[twice] + left[twice] - before] = True
    for i, (b, c) in enumerate(zip(base.tolist(), count.tolist())):
        out[i] = flat[b : b + c]
    return out


def _runs(hit: np.ndarray, lo: int, length: int) -> list[dict]:
    """Byte spans covered by the strings that begin where `hit` is set."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"lo": lo + a, "hi": lo + b - 1 + length} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _sort_groups(length: int, most: int = 1 << 19):
    """Rows (id, th, lo, left, n, copies, h, seg) in order of h to (id, th, spans) of segments that occur once."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        segments = rows.column("seg").to_pylist()
        data = np.frombuffer(b"".join(segments), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
        left, count, h, lo, copies = (rows.column(c).to_numpy() for c in ("left", "n", "h", "lo", "copies"))
        hits = repeated_starts(data, offsets, left.astype(np.int64), count.astype(np.int64), h, length)
        spans = [_runs(x, a, length) if c == 1 else [] for x, a, c in zip(hits, lo.tolist(), copies.tolist())]
        some = [i for i, s in enumerate(spans) if s]
        keys = rows.select(["id", "th"]).take(some)
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.RecordBatch.from_arrays([*[keys.column(c).combine_chunks() for c in ("id", "th")], pa.array([spans[i] for i in some], type=kind)], names=["id", "th", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                h = held.column("h").to_numpy()
                size = np.cumsum(held.column("n").to_numpy().astype(np.int64) + length)
                # whole groups only, as many as fit
                ends = np.flatnonzero(np.concatenate([h[1:] != h[:-1], [False]])) + 1
                if not len(ends) or size[ends[-1] - 1] < most:
                    break
                cut = int(ends[np.searchsorted(size[ends - 1], most)])
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _string_hashes(length: int):
    """Rows (id, th, lo, n, copies, seg) to (id, th, lo, copies, w1, w2), one for each string of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = np.frombuffer(batch.column("seg")[i].as_py(), dtype=np.uint8)
                at = np.arange(batch.column("n")[i].as_py())
                take = pa.array(np.full(len(at), i))
                two = [mix64(range_hashes(prefix_hashes(data, v), at, at + length)).view(np.int64) for v in (seeds(256, 77), seeds(256, 78))]
                columns = [batch.column(c).take(take) for c in ("id", "th", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at + batch.column("lo")[i].as_py()), *[pa.array(w) for w in two]], names=["id", "th", "copies", "lo", "w1", "w2"])

    return run


def _apply(length: int, gram: int, keep: list[str], with_text: bool):
    """Rows (..., text, full, spans) to (..., n_bytes, n_removed, n_spans, kept_sha256 [, text])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(_texts(batch.column("text")), batch.column("full").to_pylist(), batch.column("spans").to_pylist())
            for text, full, spans in rows:
                size = len(text)
                edge = np.zeros(size + 1, dtype=np.int64)
                if full:
                    _, lo, hi, _, _, d = anchors(np.frombuffer(text, dtype=np.uint8), np.array([0, size]), length, gram)
                    # all places of the segments that are named by their first
                    j = np.isin(d, d[np.array(full)])
                    np.add.at(edge, lo[j], 1)
                    np.add.at(edge, hi[j] + length, -1)
                for part in spans or []:
                    for s in part:
                        edge[s["lo"]] += 1
                        edge[s["hi"]] -= 1
                gone = np.cumsum(edge)[:size] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                rest = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if len(turns) else text
                row = (size, size - len(rest), len(turns) // 2, hashlib.sha256(rest).hexdigest())
                out.append((*row, _whole_letters(text, turns.reshape(-1, 2).tolist())) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 5 if with_text else 4]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: len(kinds)]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, type=k) for c, k in zip(columns, kinds)]], names=[*keep, *names])

    return run


def _whole_letters(text: bytes, spans: list[list[int]]) -> str:
    """The text without the spans; a letter that is only in part inside a span stays."""
    parts, at = [], 0
    for a, b in spans:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            parts.append(text[at:a])
            at = b
    return b"".join([*parts, text[at:]]).decode()


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    with_text: bool = True,
    length: int = LENGTH,
    gram: int = GRAM,
    most_sorted: int = SORTED,
) -> DataFrame:
    """Every document without the bytes of strings of `length` that also start elsewhere, in it or in another.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of what is left) to the columns `keep` (all
    but the text unless given), and with `with_text` the remaining `text`, in which letters of several bytes are never cut.
    A null or empty text has 0 bytes and stays empty; texts shorter than `length` lose nothing. Repeated rows
    are copies of each other, so all of a long enough text goes. Null keys are allowed. Columns of the result's names are
    replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in new]
    kind = docs.select(col(key)).dtypes[0][1]
    mark = "struct<x:bigint,n:int>"
    raw = col(text).cast("binary").alias("text")
    # tells texts with the same key apart
    th = F.struct(F.xxhash64(col(text)).alias("x"), F.coalesce(F.octet_length(col(text)), F.lit(0)).alias("n")).alias("th")
    rows = docs.select(col(key).alias("id"), th, raw)
    found = rows.mapInArrow(_anchor_rows(length, gram), f"id {kind}, th {mark}, j int, h long, d long, c int")

    shared = found.groupBy(F.col("h").alias("h2")).agg(F.sum("c").alias("n"), (F.min("d") != F.max("d")).alias("mixed"))
    # stored, so that the join stands on two plain shuffles and a frequent anchor can be split
    shared = stored(shared.where("n > 1").select("h2", "mixed"))
    met = found.join(shared, F.col("h") == F.col("h2"))
    hits = stored(met.select("id", "th", "j", "c", *[F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("h", "d")]))

    # segments that differ around one anchor; one row per distinct segment
    mixed = hits.where("h IS NOT NULL")
    classes = stored(mixed.groupBy("h", "d").agg(F.sum("c").alias("copies"), F.min(F.struct("id", "th", "j")).alias("one")))
    copied = classes.where("copies > 1").select(F.col("h").alias("h2"), F.col("d").alias("d2"))
    again = mixed.join(copied, (F.col("h") == F.col("h2")) & (F.col("d") == F.col("d2")), "left_semi")
    full = hits.where("h IS NULL").select("id", "th", "j").union(again.select("id", "th", "j"))
    # a key and text that occur twice have their marks twice
    full = full.distinct().groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_list("j").alias("full"))

    many = classes.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("k")).where(f"k > {most_sorted}").select("h2")
    flagged = classes.join(many, F.col("h") == F.col("h2"), "left").select("one.*", "copies", F.col("h2").isNotNull().alias("many"))
    want = flagged.groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("j", "copies", "many")).alias("want"))
    packed = rows.mapInArrow(_compress, rows.schema)
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    # of rows with the same key and text one is cut
    wanted = packed.join(want, same).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("want").alias("want"))
    segments = stored(
        wanted.mapInArrow(_cut_segments(length, gram), f"id {kind}, th {mark}, lo long, left int, n int, copies long, h long, many boolean, seg binary")
    )
    spans = "array<struct<lo:bigint,hi:bigint>>"
    few = segments.where("NOT many").drop("many").repartition("h").sortWithinPartitions("h", "id", "th", "lo")
    sorted_ = few.mapInArrow(_sort_groups(length), f"id {kind}, th {mark}, spans {spans}")
    strings = segments.where("many").mapInArrow(_string_hashes(length), f"id {kind}, th {mark}, copies long, lo long, w1 long, w2 long")
    twice = strings.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    other = strings.where("copies = 1").join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), "left_semi")
    each = F.array(F.struct("lo", (F.col("lo") + length).alias("hi")))
    partial = sorted_.union(other.select("id", "th", each.cast(spans).alias("spans")))
    partial = partial.groupBy(F.col("id").alias("id3"), F.col("th").alias("th3")).agg(F.collect_list("spans").alias("spans"))

    # helper names for all columns, as any name may be taken
    inner = [f"c{k}" for k in range(len(keep))]
    kept = docs.select(*[col(c).alias(k) for c, k in zip(keep, inner)], raw, col(key).alias("ci"), th.alias("ct"))
    shipped = kept.mapInArrow(_compress, kept.schema)
    marked = shipped.join(full, F.col("ci").eqNullSafe(F.col("id2")) & (F.col("ct") == F.col("th2")), "left").drop("id2", "th2")
    marked = marked.join(partial, F.col("ci").eqNullSafe(F.col("id3")) & (F.col("ct") == F.col("th3")), "left").drop("id3", "th3", "ci", "ct")
    result = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, inner)])
    for c in new:
        result = result.add(c, T.StringType() if c == "kept_sha256" else T.LongType())
    if with_text:
        result = result.add("text", T.StringType())
    return marked.mapInArrow(_apply(length, gram, inner, with_text), result).toDF(*keep, *new, *([text] if with_text else []))
