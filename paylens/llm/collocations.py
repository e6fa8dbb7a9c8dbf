"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

First pass: the n-grams of all texts are hashed to partitions, so many that each gets some PARTITION_MASS of them. A
partition's Misra-Gries summary holds more counters than its mass divided by the threshold, so that what
is taken off its counters stays below the threshold: no n-gram that is frequent enough can be missing from it. Summaries
are merged chunk by chunk in bounded memory. The survivors' hashes become a bitmap of fixed size. Second pass: n-grams whose
bit is set, and those of all n-grams inside them, are counted exactly, as texts. Hashes that share a bit only add
n-grams to this count, which the threshold then removes. Inside a block of texts n-grams are told apart by 64-bit hashes, beyond it as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.hashing import _LOWER, blocks, mix64, prefix_hashes, range_hashes, seeds
from paylens.llm.tables import col, small_batches
from paylens.session import stored

LEAST = 100
LONGEST = 5
TOP = 2000
# n-grams of one hash partition, about; counters beyond mass / threshold; hashes sorted at once
PARTITION_MASS = 1 << 22
SPARE = 4
CHUNK = 1 << 22
BITS = 27
STEP = 2 << 20
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


def pieces_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words, the number of the first word of each row, and the piece of each word."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return starts, ends, first, np.cumsum(kind == 2)[starts] + row


def ngram_hashes(words: np.ndarray, piece: np.ndarray, longest: int, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to `longest`: hashes of the n-grams that start at each word, and whether they stay in its piece.

    `salt` is a hash of the language of each word.
    """
    for n in range(1, longest + 1):
        m = max(0, len(words) - n + 1)
        total = salt[:m] + np.uint64(n)
        for j, factor in enumerate(seeds(n, 60 + n)):
            total = total + words[j : j + m] * factor
        yield mix64(total), piece[n - 1 :] == piece[:m] if m else np.zeros(0, dtype=bool)


def _block_words(data: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lowered bytes, word starts, ends, words per row, pieces, word hashes, language salt of each word."""
    low = _LOWER[data]
    starts, ends, first, piece = pieces_words(low, offsets)
    words = mix64(range_hashes(prefix_hashes(low), starts, ends) + (ends - starts).astype(np.uint64))
    counts = np.diff(first)
    return low, starts, ends, counts, piece, words, np.repeat(mix64(languages.view(np.uint64)), counts)


def _sketch(longest: int, partitions: int):
    """Rows (lang, lh, text) to (p, kind, mass, once, many, times): per chunk and partition its mass (kind 0) and its hashes (kind 1)."""

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        times = np.diff(np.append(new, len(x)))
        x = x[new]
        p = ((x >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(p, np.arange(partitions + 1))
        total = np.concatenate([[0], np.cumsum(times)])
        rest = x.astype(np.uint32)
        out: list[tuple] = []
        for i in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[i], cut[i + 1])
            more = times[part] > 1
            out.append((i, 0, int(total[cut[i + 1]] - total[cut[i]]), None, None, None))
            out.append((i, 1, 0, rest[part][~more].tobytes(), rest[part][more].tobytes(), times[part][more].astype(np.uint32).tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["p", "kind", "mass", "once", "many", "times"]
        for a in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out[a : a + 512]), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            languages = batch.column("lh").to_numpy()
            for row, data, offsets in blocks(batch.column("text"), STEP):
                _, _, _, _, piece, words, salt = _block_words(data, offsets, languages[row : row + len(offsets) - 1])
                held += [x[inside] for x, inside in ngram_hashes(words, piece, longest, salt)]
                if sum(len(h) for h in held) >= CHUNK:
                    yield from pack(held)
                    held = []
        if any(len(h) for h in held):
            yield from pack(held)

    return run


class Summary:
    """A Misra-Gries summary of 32-bit keys with weights, merged chunk by chunk.

    `taken` is what at most was taken off any key's counter: below mass / capacity. Counters saturate at 2 ** 31.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        most = np.int64(1) << 31
        both = np.concatenate([self.keys, keys]).astype(np.uint64) << np.uint64(32)
        both |= np.minimum(np.concatenate([self.counts, counts]), most).astype(np.uint64)
        both.sort()
        key = (both >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), begin) if len(key) else np.zeros(0, dtype=np.int64)
        self.keys, self.counts = key[begin], np.minimum(sums, most)
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > off
            self.keys, self.counts = self.keys[stay], self.counts[stay] - off
            self.taken += off

    def above(self, least: int) -> np.ndarray:
        """Keys that may have `least` or more."""
        return self.keys[self.counts + self.taken >= least]


def _survivors(least: int, spare: int):
    """Rows of _sketch in order of (p, kind) to the bits of all n-grams that may be frequent."""

    def merge(summary: Summary, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if held:
            summary.merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held.clear()

    def bits(summary: Summary) -> pa.RecordBatch:
        bit = summary.above(least) & np.uint32((1 << BITS) - 1)
        return pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], names=["bit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, held = None, 0, None, []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("p", "kind", "mass")], *[batch.column(c) for c in ("once", "many", "times")])
            for p, kind, more, once, many, times in rows:
                if p != part:
                    if summary is not None:
                        merge(summary, held)
                        yield bits(summary)
                    part, mass, summary = p, 0, None
                if kind == 0:
                    mass += more
                    continue
                if summary is None:
                    # the whole mass of the partition is known before its first hash
                    summary = Summary(spare * (mass // least) + 1024)
                one, two = np.frombuffer(once.as_py(), dtype=np.uint32), np.frombuffer(many.as_py(), dtype=np.uint32)
                held.append((np.concatenate([one, two]), np.concatenate([np.ones(len(one), dtype=np.int64), np.frombuffer(times.as_py(), dtype=np.uint32).astype(np.int64)])))
                if sum(len(k) for k, _ in held) >= CHUNK:
                    merge(summary, held)
        if summary is not None:
            merge(summary, held)
            yield bits(summary)

    return run


def _slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts values[start : start + size]."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values[at].tobytes())).cast(pa.string())


def _count(longest: int, shared):
    """Rows (lang, lh, text) to (lang, n, phrase, c); n = 0 counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            languages = batch.column("lh").to_numpy()
            for row, data, offsets in blocks(batch.column("text"), STEP):
                low, starts, ends, counts, piece, words, salt = _block_words(data, offsets, languages[row : row + len(offsets) - 1])
                n_rows = len(counts)
                owner = np.repeat(np.arange(n_rows), counts)
                # words with one space after each, so that a phrase is one run of bytes
                size = ends - starts + 1
                base = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(base[-1]) + np.repeat(starts - base[:-1], size)
                spaced = low[np.minimum(at, max(0, len(low) - 1))]
                spaced[base[1:] - 1] = 0x20
                out = [(batch.column("lang").slice(row, n_rows), np.zeros(n_rows, dtype=np.int32), pa.array([""] * n_rows), counts)]
                live = None
                for n, (x, inside) in enumerate(ngram_hashes(words, piece, longest, salt), 1):
                    live = inside if live is None else inside & live[:-1] & live[1:]
                    bit = (x & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    live = live & ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                    hit = np.flatnonzero(live)
                    if not len(hit):
                        break
                    _, some, times = np.unique(x[hit], return_index=True, return_counts=True)
                    some = hit[some]
                    phrase = _slices(spaced, base[some], base[some + n] - 1 - base[some])
                    out.append((batch.column("lang").take(pa.array(owner[some] + row)), np.full(len(some), n, dtype=np.int32), phrase, times))
                for lang, n, phrase, c in out:
                    yield pa.RecordBatch.from_arrays([lang, pa.array(n), phrase, pa.array(c.astype(np.int64))], names=["lang", "n", "phrase", "c"])

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, spare: int = SPARE) -> DataFrame:
    """(lang, n, phrase, f): all phrases of 1 to `longest` words that occur `least` times or more in a language.

    n = 0 has one row per language with the number of all its words. The capacity of a summary is `spare` times its mass
    divided by `least`, and 1024.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).alias("raw"))
    rows = rows.select("lang", F.xxhash64("lang").alias("lh"), F.col("raw").cast("binary").alias("text"))
    # partitions of about equal mass; a text has some n-gram for every second byte
    size = docs.agg(F.coalesce(F.sum(F.octet_length(col(text))), F.lit(0))).first()[0]
    partitions = max(64, size // (2 * PARTITION_MASS))
    with small_batches(spark):
        packed = rows.mapInArrow(_sketch(longest, partitions), "p int, kind int, mass long, once binary, many binary, times binary")
        placed = packed.repartition("p").sortWithinPartitions("p", "kind")
        alive = placed.mapInArrow(_survivors(least, spare), "bit long")
        # at most 2 ** BITS bits, whatever the data
        words = alive.groupBy((F.col("bit") / 32768).cast("int").alias("w")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("b"))
        bitmap = bytearray((1 << BITS) // 8)
        for r in words.collect():
            bitmap[r["w"] * 4096 : (r["w"] + 1) * 4096] = r["b"]
        shared = spark.sparkContext.broadcast(bytes(bitmap))
        counted = rows.mapInArrow(_count(longest, shared), "lang string, n int, phrase string, c long")
        found = counted.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f")).where(f"n = 0 OR f >= {least}")
        return stored(found)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, spare: int = SPARE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose words occur together most beyond chance.

    Texts are lowered (A to Z) and split at [.,;:!?] and line ends into pieces; a phrase is a run of 2 to `longest` words in a
    piece. a, l and r count a phrase and the two parts of its lowest-scoring cut, n all words of the language; score is the whole
    part of 1000 a n / (l r), ties go to the earliest cut. Phrases inside a longer one that is as frequent are left out. `top`
    phrases of each language by score, a and phrase; all with None. A null language is `und`; null, empty and blank texts have no
    words, and a repeated row counts as often as it is there. Other columns are never read.
    """
    found = frequent_phrases(docs, text, lang, least, longest, spare)
    totals = found.where("n = 0").select("lang", F.col("f").alias("total"))
    known = found.where("n > 0").select("lang", "phrase", "f")
    cuts = found.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    left = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("left", left).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = stored(cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    wide = "CAST({} AS DECIMAL(38, 0))".format
    score = F.expr(f"1000 * {wide('a')} * {wide('total')} DIV ({wide('l')} * {wide('r')})")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer phrase as frequent as a part of it: then so is the one that is longer by one word
    inner = cuts.where("n > 2 AND k = n - 1 AND l = a").select("lang", F.col("left").alias("phrase"))
    inner = inner.union(cuts.where("n > 2 AND k = 1 AND r = a").select("lang", F.col("right").alias("phrase"))).distinct()
    rest = best.join(inner, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = rest.withColumn("rank", F.expr(order).cast("long"))
    if top is not None:
        ranked = ranked.where(f"rank <= {top}")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
