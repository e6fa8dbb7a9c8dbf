"""Token ids in canonical, length-limited Huffman code.

Code lengths come from the counts of the whole corpus by package-merge, codes from the lengths alone. A block holds
whole documents and can be decoded by itself; a checkpoint gives the bit offset of every STRIDE-th token, so the
decoder starts at all checkpoints of a block at once and steps through a table of all LIMIT-bit words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.llm.hashing import blocks, mix64, prefix_hashes, range_hashes, words
from paylens.llm.tables import col, small_batches
from paylens.session import stored

# with the seven bits before it, a code lies within three bytes
LIMIT = 17
STRIDE = 128
# a block is closed by the document that brings it to so many tokens
BLOCK = 1 << 16
END = 0

BLOCK_SCHEMA = (
    "shard int, block int, before long, doc_ids array<{kind}>, doc_tokens array<long>, n_tokens long, checkpoints array<long>, payload binary"
)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length of every symbol, at most `limit` bits; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    leaves, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        at = np.argsort(merged, kind="stable")
        leaves.append(np.cumsum(at < n))
        merged = merged[at]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take = 2 * n - 2
    depth = np.zeros(n, dtype=np.uint8)
    for level in reversed(leaves):
        here = int(level[take - 1]) if take else 0
        depth[:here] += 1
        take = 2 * (take - here)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend with (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max(initial=0))
    # each code in units of the longest code's last bit
    units = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    codes[order] = ((np.cumsum(units) - units) >> (top - lengths[order]).astype(np.uint64)).astype(np.uint32)
    return codes


def _reach(lengths: np.ndarray) -> int:
    """Bytes that the longest code may touch."""
    return (int(lengths.max(initial=1)) + 14) // 8


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of every stride-th token."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    size = (total + 7) // 8
    byte = starts >> 3
    wide = _reach(lengths)
    window = codes[ids].astype(np.int64) << (8 * wide - bits - (starts & 7))
    out = np.zeros(size + wide, dtype=np.uint8)
    for i in range(wide):
        # codes do not overlap, so sums are unions
        part = (window >> (8 * (wide - 1 - i))) & 255
        out += np.bincount(byte + i, weights=part, minlength=size + wide).astype(np.uint8)
    return out[:size].tobytes(), starts[::stride].copy()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For every word of the longest code's bits: symbol, its length; those bits, and the bytes they may touch."""
    top = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = (1 << (top - lengths[order]).astype(np.int64)).astype(np.int64)
    symbols, sizes = np.zeros(1 << top, dtype=np.uint32), np.ones(1 << top, dtype=np.uint8)
    filled = int(width.sum())
    symbols[:filled] = np.repeat(order, width)
    sizes[:filled] = np.repeat(lengths[order], width)
    return symbols, sizes, top, _reach(lengths)


def decode(payload: bytes, at: np.ndarray, counts: np.ndarray, table: tuple) -> np.ndarray:
    """The ids of all lanes, one lane after the other; a lane begins at a bit offset and has a count.

    All lanes are stepped at once.
    """
    symbols, sizes, top, wide = table
    data = np.frombuffer(payload + bytes(wide), dtype=np.uint8)
    words = np.zeros(len(data) - wide + 1, dtype=np.int64)
    for i in range(wide):
        words = (words << 8) | data[i : i + len(words)]
    order = np.argsort(-counts, kind="stable")
    at, left = np.asarray(at, dtype=np.int64)[order], counts[order]
    steps = int(left[0]) if len(left) else 0
    out = np.zeros((steps, len(at)), dtype=np.uint32)
    lanes = np.searchsorted(-left, -np.arange(steps), side="left")  # lanes with more ids than the step's number
    mask, shift = (1 << top) - 1, 8 * wide - top
    for step, n in enumerate(lanes.tolist()):
        here = at[:n]
        word = (words[here >> 3] >> (shift - (here & 7))) & mask
        out[step, :n] = symbols[word]
        here += sizes[word]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return out.T[back][np.arange(steps)[None, :] < counts[:, None]]


def lane_counts(n: int, stride: int = STRIDE) -> np.ndarray:
    """How many ids each checkpoint of a run of n ids stands for."""
    return np.diff(np.append(np.arange(0, n, stride), n))


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
# pieces are found again by the first bits of their hash
_BITS = 21


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that have no other white space than single spaces and single line ends between other text."""
    blank = _BLANK[data]
    odd = blank & (data != 0x20) & (data != 0x0A)
    odd[1:] |= blank[1:] & blank[:-1]
    filled = offsets[:-1] < offsets[1:]
    odd[offsets[:-1][filled]] |= blank[offsets[:-1][filled]]
    odd[offsets[1:][filled] - 1] |= blank[offsets[1:][filled] - 1]
    # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    at = np.flatnonzero(_WIDE[data[:-2]]) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    x, y, z = data[at], data[at + 1], data[at + 2]
    wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | np.isin(z, [0xA8, 0xA9, 0xAF])) | (y == 0x81) & (z == 0x9F))
    odd[at[wide]] = True
    odd[-2:] |= data[-2:] == 0xC2
    plain = filled.copy()
    plain[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = False
    return plain


class Pieces:
    """Ids of texts by way of their pieces.

    The tokenizer never joins text across a single space or line end that has other text on both sides, nor a letter or
    digit with punctuation after it. So each distinct word (with its space) and each run of punctuation at a
    word's end is encoded by the library once, many in one text of lines, and its ids are looked up by hash from then on. Texts
    with other white space or with an added token go to the library whole. At most `most` pieces are remembered, in arrays.
    """

    def __init__(self, tokenizer: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(tokenizer), most
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.library(["\n"])[0]
        self.by_piece = len(self.line) == 1 and self.library(["a\n b.\nc"])[0].count(self.line[0]) == 2
        self.clear()

    def clear(self) -> None:
        """Forget all but the line end, which parts the pieces when others are learned."""
        self.known, self.number = np.zeros(1 << _BITS, dtype=np.uint64), np.zeros(1 << _BITS, dtype=np.int32)
        self.flat, self.start, self.size = np.array(self.line[:1], dtype=np.uint32), np.array([0], dtype=np.int32), np.array([1], dtype=np.int32)

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64)
        return mix64(range_hashes(prefix_hashes(data), starts, ends) + np.uint64(3) * size + kinds.astype(np.uint64))

    def library(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces. A piece whose place is wanted by another is forgotten, and learned anew when it is met."""
        lines = ["\n".join(pieces[i : i + 512]) for i in range(0, len(pieces), 512)]
        flat = np.concatenate([np.array([*ids, *self.line], dtype=np.uint32) for ids in self.library(lines)])
        ends = np.flatnonzero(flat == self.line[0])
        size = np.diff(np.concatenate([[-1], ends])) - 1
        flat = np.delete(flat, ends)
        first, base = len(self.size), len(self.flat)
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size.astype(np.int32)])
        self.start = np.concatenate([self.start, (base + np.cumsum(size) - size).astype(np.int32)])
        place = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        self.known[place], self.number[place] = keys, first + np.arange(len(keys), dtype=np.int32)
        return first + np.arange(len(keys), dtype=np.int32)

    def _items(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, kind and row of all pieces: kind 0 after a space, 1 at a line's begin or a word's end, 2 a line end."""
        starts, ends, first = words(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        begin = np.zeros(len(starts), dtype=bool)
        begin[first[:-1][np.diff(first) > 0]] = True
        line = ~begin & (data[starts - 1] == 0x0A)
        # the end of the last letter or digit before a word's closing run of marks
        core = ends.copy()
        marked = np.flatnonzero(_MARK[data[ends - 1]])
        while len(marked):
            core[marked] -= 1
            marked = marked[core[marked] > starts[marked]]
            marked = marked[_MARK[data[core[marked] - 1]]]
        tail = (core < ends) & (core > starts) & _ALNUM[data[core - 1]]
        core = np.where(tail, core, ends)
        at = np.cumsum(1 + line + tail) - 1 - tail  # where each word goes
        total = int(at[-1] + 1 + tail[-1]) if len(at) else 0
        s, e, k, r = (np.empty(total, dtype=t) for t in (np.int64, np.int64, np.uint8, np.int64))
        for place, values in ((at, (starts, core, np.where(begin | line, 1, 0), row)), (at[line] - 1, (starts[line] - 1, starts[line], 2, row[line])), (at[tail] + 1, (core[tail], ends[tail], 1, row[tail]))):
            for out, value in zip((s, e, k, r), values):
                out[place] = value
        return s, e, k, r

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a block of UTF-8 texts."""
        if len(self.size) > self.most:
            self.clear()
        out: list = [np.zeros(0, dtype=np.uint32)] * (len(offsets) - 1)
        plain = plain_rows(data, offsets) if self.by_piece else np.zeros(len(out), dtype=bool)
        whole = data.tobytes() if plain.any() else b""
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                plain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = whole.find(token, at + 1)
        odd = np.flatnonzero(~plain & (offsets[1:] > offsets[:-1]))
        for i, ids in zip(odd.tolist(), self.library([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in odd.tolist()])):
            out[i] = np.array(ids, dtype=np.uint32)
        if not plain.any():
            return out
        s, e, kind, row = self._items(data, offsets)
        use = plain[row]
        s, e, kind, row = s[use], e[use], kind[use], row[use]
        keys = self._keys(data, s, e, kind)
        place = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        number = np.where(kind == 2, 0, self.number[place])
        missing = np.flatnonzero((self.known[place] != keys) & (kind != 2))
        if len(missing):
            new, at, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[at]
            raw, found = data.tobytes(), zip(s[at].tolist(), e[at].tolist(), kind[at].tolist())
            learned = self._learn(new, [raw[a:b].decode() if k else " " + raw[a:b].decode() for a, b, k in found])
            number[missing] = learned[inverse]
        size = self.size[number].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[number] - (ends - size), size)]
        bound = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(out) + 1))]
        for i in np.flatnonzero(plain).tolist():
            out[i] = flat[bound[i] : bound[i + 1]]
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        out = []
        for _, data, offsets in blocks(pa.array([t if t is None else t.encode() for t in texts], type=pa.binary())):
            out += self.encode_rows(data, offsets)
        return out


def _worker_pieces(tokenizer: str) -> Pieces:
    """The pieces of this Python worker, kept from task to task."""
    # a task has one core; threads of the library would each hold memory of their own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    held = vars(tokenizers).setdefault("_pieces_by_file", {})
    if tokenizer not in held:
        held[tokenizer] = Pieces(tokenizer)
    return held[tokenizer]


def _tokenize(tokenizer: str, size: int):
    """Rows (id, text) to (id, n, ids, count): ids compressed; the last row of a task has its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pieces, pack, kind = _worker_pieces(tokenizer), zstandard.ZstdCompressor(level=1), None
        counts = np.zeros(size, dtype=np.int64)
        names = ["id", "n", "ids", "count"]
        for batch in batches:
            kind = batch.column("id").type
            for done, data, offsets in blocks(batch.column("text")):
                each = [np.append(ids, np.uint32(END)) for ids in pieces.encode_rows(data, offsets)]
                counts += np.bincount(np.concatenate(each), minlength=size)
                columns = [
                    batch.column("id").slice(done, len(each)),
                    pa.array([len(ids) for ids in each], type=pa.int64()),
                    pa.array([pack.compress(ids.astype(_stored_type(size)).tobytes()) for ids in each], type=pa.binary()),
                    pa.nulls(len(each), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if kind is not None:
            columns = [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _stored_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _recode(lengths: np.ndarray, block: int, stride: int):
    """Rows (id, n, ids) in order to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codes, unpack = canonical_codes(lengths), zstandard.ZstdDecompressor()
        shard, number, before, held, size, kind = TaskContext.get().partitionId(), 0, 0, [], 0, None

        def block_of(parts: list) -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in parts])
            payload, at = encode(ids, codes, lengths, stride)
            columns = [
                pa.array([shard], type=pa.int32()),
                pa.array([number], type=pa.int32()),
                pa.array([before], type=pa.int64()),
                pa.array([[x for x, _ in parts]], type=pa.list_(kind)),
                pa.array([[len(x) for _, x in parts]], type=pa.list_(pa.int64())),
                pa.array([len(ids)], type=pa.int64()),
                pa.array([at], type=pa.list_(pa.int64())),
                pa.array([payload], type=pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "before", "doc_ids", "doc_tokens", "n_tokens", "checkpoints", "payload"])

        for batch in batches:
            kind = batch.column("id").type
            for key, packed in zip(batch.column("id").to_pylist(), batch.column("ids")):
                held.append((key, np.frombuffer(unpack.decompress(packed.as_py()), dtype=_stored_type(len(lengths))).astype(np.uint32)))
                size += len(held[-1][1])
                if size >= block:
                    yield block_of(held)
                    number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield block_of(held)

    return run


def _read(lengths: np.ndarray, as_bytes: bool):
    """Blocks with their first token's number to rows (id, start, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in ("doc_ids", "doc_tokens", "n_tokens", "checkpoints", "payload", "first")}
                n, at = row["n_tokens"].as_py(), row["checkpoints"].values.to_numpy()
                # checkpoints are as many as strides began
                ids = decode(row["payload"].as_py(), at, lane_counts(n, batch.column("stride")[i].as_py()), table)
                sizes = row["doc_tokens"].values.to_numpy()
                ends = np.cumsum(sizes)
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                if as_bytes:
                    held = [pa.array(4 * np.append(0, ends).astype(np.int32)).buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())]
                    lists = pa.Array.from_buffers(pa.binary(), len(sizes), [None, *held])
                else:
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))
                columns = [
                    row["doc_ids"].values,
                    pa.array(row["first"].as_py() + ends - sizes),
                    pa.array(sizes),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids"])

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
    stride: int = STRIDE,
    limit: int = LIMIT,
) -> None:
    """Encode every text and write its ids, with END after each document, in ascending key order.

    `path`/code holds the code length of every id that occurs and the stride, `path`/blocks the blocks. A null text is empty
    and has the END only; null keys come first; repeated rows are separate documents. Texts are
    tokenized once, into a table of compressed ids that waits for the code.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()
    size = Pieces(tokenizer).tokenizer.get_vocab_size()
    rows = docs.select(col(key).alias("id"), col(text).cast("binary").alias("text"))
    kind = rows.dtypes[0][1]
    with small_batches(docs.sparkSession):
        coded = stored(rows.mapInArrow(_tokenize(tokenizer, size), f"id {kind}, n long, ids binary, count array<long>"))

    per_id = coded.where("count IS NOT NULL").select(F.posexplode("count").alias("id", "n")).where("n > 0")
    counted = per_id.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(size, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, limit)
    spark = docs.sparkSession
    code = [(int(i), int(lengths[i]), stride) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "id int, length int, stride int").coalesce(1).write.parquet(f"{path}/code")

    ordered = coded.where("count IS NULL").drop("count").repartitionByRange("id").sortWithinPartitions("id", "n", "ids")
    blocks = ordered.mapInArrow(_recode(lengths, block, stride), BLOCK_SCHEMA.format(kind=kind))
    with small_batches(spark):
        blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document of a written corpus; start counts the ids of all documents before it.

    ids is an array of integers, or with `as_bytes` their little-endian 32-bit form.
    """
    code = spark.read.parquet(f"{path}/code").collect()  # at most the vocabulary
    lengths = np.zeros(max([r["id"] for r in code], default=0) + 1, dtype=np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = blocks.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    # one row per shard, of which there are as many as tasks that wrote the blocks
    starts = F.broadcast(sizes.select("s", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    placed = blocks.join(starts, F.col("shard") == F.col("s")).withColumn("first", F.col("base") + F.col("before"))
    stride = F.lit(code[0]["stride"] if code else STRIDE).alias("stride")
    return placed.select("doc_ids", "doc_tokens", "n_tokens", "checkpoints", "payload", "first", stride).mapInArrow(
        _read(lengths, as_bytes), f"id {kind}, start long, n_tokens long, ids {'binary' if as_bytes else 'array<int>'}"
    )
