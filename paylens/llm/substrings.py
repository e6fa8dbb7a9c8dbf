"""Repeated runs of words by difference-cover anchors.

COVER is a difference cover modulo PERIOD: for any two places there is a shift below PERIOD that brings both to
cover places, which are those whose number in the text, modulo the period, is in the cover. So two equal windows of WINDOW words
always hold a pair of equal anchors, the WINDOW - PERIOD + 1 words at such places. Only anchors at cover places are
hashed, about a third of all. Of those that occur more than once, each is extended to its segment: all words of the windows that
hold the anchor at its place. Occurrences with equal segments are one class, of which all but the earliest repeat
throughout; only where segments of one anchor differ are the windows of each class's earliest occurrence compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.llm.hashing import STEP, blocks, mix64, powers, range_hashes, seeds, word_hashes
from paylens.llm.suffixes import _compress, _texts
from paylens.llm.tables import col
from paylens.session import stored

WINDOW = 20
# a perfect difference set: every residue but 0 is the difference of one pair
PERIOD, COVER = 13, (0, 1, 3, 9)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _prefix(hashes: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes), base), out=out[1:])
    return out


def _ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix), pow(base, -1, 1 << 64))[starts])


def cover_anchors(hashes: np.ndarray, first: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Row, place, anchor hash and segment hash of the anchors of a block of texts, given as hashes of their words.

    The segment hash also tells how far a segment reaches to both sides, as texts end.
    """
    gram, sizes = window - period + 1, np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - first[row]
    use = np.flatnonzero(np.isin(place % period, cover) & (place + gram <= sizes[row]) & (sizes[row] >= window))
    row, place = row[use], place[use]
    lo = np.maximum(place - (period - 1), 0)
    hi = np.minimum(place + window, sizes[row])
    prefix = _prefix(hashes, _BASES[0])
    anchor = _ranges(prefix, use, use + gram, _BASES[0])
    shape = (place - lo).astype(np.uint64) * np.uint64(0x9E3779B1) + (hi - lo).astype(np.uint64)
    base = first[row]
    segment = mix64(_ranges(prefix, base + lo, base + hi, _BASES[0]) + mix64(shape + np.uint64(1)))
    return row, place, anchor, segment


def _anchor_rows(window: int, period: int, cover: tuple[int, ...]):
    """Rows (id, th, text) to (id, th, pos, more, h, d), one for each distinct segment of a text: its first place and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for done, data, offsets in blocks(batch.column("text"), STEP):
                hashes, first = word_hashes(data, offsets, lower=False)
                row, place, h, d = cover_anchors(hashes, first, window, period, cover)
                # equal segments of a text side by side, the first place first
                order = np.lexsort((place, d, h, row))
                new = np.ones(len(order), dtype=bool)
                same = [x[order][1:] == x[order][:-1] for x in (row, h, d)]
                new[1:] = ~(same[0] & same[1] & same[2])
                begin = np.flatnonzero(new)
                head, count = order[begin], np.diff(np.append(begin, len(order)))
                others = np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(others), pa.array(place[order[~new]].astype(np.int32)), mask=pa.array(count == 1))
                take = pa.array(row[head] + done)
                columns = [batch.column("id").take(take), batch.column("th").take(take), pa.array(place[head].astype(np.int32)), more]
                columns += [pa.array(x[head].view(np.int64)) for x in (h, d)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "pos", "more", "h", "d"])

    return run


def _windows(window: int, period: int):
    """Rows (id, th, text, want) to (id, th, start, w1, w2): the windows that hold a wanted anchor at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            pos, ends = want.values.to_numpy(), want.offsets.to_numpy().astype(np.int64)
            for done, data, offsets in blocks(pa.array(list(_texts(batch.column("text"))), type=pa.large_binary())):
                hashes, first = word_hashes(data, offsets, lower=False)
                mine = ends[done : done + len(offsets)]
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(mine))
                # numbers among all words of the block, so that a number tells its text
                at = (first[row] + pos[mine[0] : mine[-1]])[:, None] - np.arange(period)[None, :]
                fits = (at >= first[row][:, None]) & (at + window <= first[row + 1][:, None])
                start = np.unique(at[fits])
                row = np.searchsorted(first, start, side="right") - 1
                two = [_ranges(_prefix(hashes, b), start, start + window, b).view(np.int64) for b in _BASES]
                one = pa.array(row + done)
                columns = [batch.column("id").take(one), batch.column("th").take(one), pa.array((start - first[row]).astype(np.int32)), *[pa.array(w) for w in two]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "start", "w1", "w2"])

    return run


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as arrays, null as an empty one."""
    values = column.values.to_numpy()
    for a, b, known in zip(column.offsets.to_pylist()[:-1], column.offsets.to_pylist()[1:], column.is_valid().to_pylist()):
        yield values[a:b] if known else values[:0]


def _apply(keep: list[str], window: int, period: int, with_text: bool):
    """Rows (..., text, full, single) to (..., n_words, n_removed, kept_sha256 [, text])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            full, single = _lists(batch.column("full")), _lists(batch.column("single"))
            for text, places, starts in zip(_texts(batch.column("text")), full, single):
                words = text.split()  # bytes are split at the six white characters of ASCII
                n = len(words)
                if len(places) or len(starts):
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, np.maximum(places - (period - 1), 0), 1)
                    np.add.at(edge, np.minimum(places + window, n), -1)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    words = [w for w, out in zip(words, (np.cumsum(edge)[:n] > 0).tolist()) if not out]
                rest = b" ".join(words)
                total.append(n), gone.append(n - len(words)), digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            columns = [pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(digest, type=pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, type=pa.string())), names.append("text")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *names])

    return run


def remove_repeated_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    with_text: bool = True,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """Every document without the words of windows of `window` words that also start earlier.

    Earlier is a smaller key or, under the same key, an earlier start; a null key comes after all others, and rows with
    the same key count as one document, so that equal rows keep the same words. Adds n_words, n_removed and kept_sha256 (of the kept
    words joined by one space) to the columns `keep` (all but the text unless given), and with `with_text` those words as
    `text`. A null, empty or blank text has no words; one with fewer than `window` words loses none. Columns of the
    result's names are replaced.
    """
    new = ["n_words", "n_removed", "kept_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in new]
    kind = docs.select(col(key)).dtypes[0][1]
    raw = col(text).cast("binary").alias("text")
    # tells texts with the same key apart
    th = F.xxhash64(col(text), F.octet_length(col(text))).alias("th")
    rows = docs.select(col(key).alias("id"), th, raw)
    found = rows.mapInArrow(_anchor_rows(window, period, cover), f"id {kind}, th long, pos int, more array<int>, h long, d long")

    # anchors that occur once are in no repeat; a list that is stored first leaves the join on two plain shuffles, which AQE can split
    shared = found.groupBy(F.col("h").alias("h2")).agg(F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0))).alias("n"))
    shared = stored(shared.where("n > 1").select("h2"))
    met = stored(found.join(shared, F.col("h") == F.col("h2"), "left_semi"))

    place = F.struct(F.col("id").isNull().alias("late"), "id", "pos")
    classes = met.groupBy("h", "d").agg(
        F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0))).alias("n"), F.min(F.struct(place.alias("p"), "th")).alias("one")
    )
    classes = stored(classes)
    again = classes.where("n > 1").select(F.col("h").alias("h2"), F.col("d").alias("d2"), F.col("one.p").alias("least"))
    # of a class all but the earliest repeat throughout; its text's other places are later ones
    later = met.join(again, (F.col("h") == F.col("h2")) & (F.col("d") == F.col("d2")))
    none = F.array().cast("array<int>")
    places = F.concat(F.when(place > F.col("least"), F.array("pos")).otherwise(none), F.coalesce("more", none))
    full = later.select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.explode(places).alias("p"))
    # the same key and text may be there twice
    full = full.groupBy("id2", "th2").agg(F.collect_set("p").alias("full"))

    # windows of the earliest occurrences of the classes that share an anchor with another class
    mixed = classes.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h2")
    want = classes.join(mixed, F.col("h") == F.col("h2"), "left_semi")
    want = want.groupBy(F.col("one.p.id").alias("id2"), F.col("one.th").alias("th2")).agg(F.collect_list("one.p.pos").alias("want"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    packed = rows.mapInArrow(_compress, rows.schema)
    wanted = packed.join(want, same).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("want").alias("want"))
    strings = stored(wanted.mapInArrow(_windows(window, period), f"id {kind}, th long, start int, w1 long, w2 long"))
    twice = strings.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.count(F.lit(1)).alias("n"))
    twice = stored(twice.where("n > 1").select("x1", "x2"))
    begin = F.struct(F.col("id").isNull().alias("late"), "id", "start")
    repeated = stored(strings.join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), "left_semi"))
    least = stored(repeated.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.min(begin).alias("least")))
    single = repeated.join(least, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))).where(begin > F.col("least"))
    single = single.groupBy(F.col("id").alias("id3"), F.col("th").alias("th3")).agg(F.collect_list("start").alias("single"))

    # helper names for all columns, as any name may be taken
    inner = [f"c{k}" for k in range(len(keep))]
    kept = docs.select(*[col(c).alias(k) for c, k in zip(keep, inner)], raw, col(key).alias("ci"), th.alias("ct"))
    shipped = kept.mapInArrow(_compress, kept.schema)
    marked = shipped.join(full, F.col("ci").eqNullSafe(F.col("id2")) & (F.col("ct") == F.col("th2")), "left").drop("id2", "th2")
    marked = marked.join(single, F.col("ci").eqNullSafe(F.col("id3")) & (F.col("ct") == F.col("th3")), "left").drop("id3", "th3", "ci", "ct")
    result = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, inner)])
    for c in new:
        result = result.add(c, T.StringType() if c == "kept_sha256" else T.LongType())
    if with_text:
        result = result.add("text", T.StringType())
    return marked.mapInArrow(_apply(inner, window, period, with_text), result).toDF(*keep, *new, *([text] if with_text else []))
