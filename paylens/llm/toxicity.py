"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; a later model sees the probabilities of the earlier ones. When it is
trained, those come from models that have not seen the document (out of fold). Features are the
distinct words of a text and their beginnings, hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.llm.hashing import blocks, mix64, prefix_hashes, range_hashes, words
from paylens.llm.tables import col

# labelled rows a chain is fitted on, at most; the driver holds their features
SAMPLE = 6_000
FOLDS = 5
SLOTS = 1 << 20
# features that each model may use, those that tell the classes apart best
CHOSEN = 8192
# documents of the sample that a feature must be in
FEW = 4
BEGINNINGS = (3, 4, 5)
# no document is flagged on a probability below this, whatever the held-out rows suggest
FLOOR = 0.1
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
_PLAIN[0x41:0x5B] += 32


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs of a block, sorted: words and their first letters, marks and case aside.

    `wanted` says of each slot whether it matters; others are left out before sorting.
    """
    data = _PLAIN[data]
    starts, ends, first = words(data, offsets)
    prefix = prefix_hashes(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = []
    for k in (0, *BEGINNINGS):
        use = slice(None) if not k else ends - starts > k
        s, e = starts[use], ends[use] if not k else starts[use] + k
        slot = (mix64(range_hashes(prefix, s, e) + np.uint64(k)) >> np.uint64(44)).astype(np.int64)
        r = row[use]
        if wanted is not None:
            keep = wanted[slot]
            slot, r = slot[keep], r[keep]
        pairs.append(r * SLOTS + slot)
    both = np.unique(np.concatenate(pairs))
    return both // SLOTS, both % SLOTS


@dataclass
class Linear:
    """A logistic model over chosen slots and the probabilities of earlier categories."""

    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margins(self, row: np.ndarray, slot: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.slots, slot)
        hit = (at < len(self.slots)) & (self.slots[np.minimum(at, len(self.slots) - 1)] == slot) if len(self.slots) else np.zeros(len(slot), dtype=bool)
        sums = np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n) if hit.any() else np.zeros(n)
        return sums + before @ self.earlier + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(row: np.ndarray, slot: np.ndarray, y: np.ndarray, before: np.ndarray, rounds: int = 80, ridge: float = 1e-4) -> Linear:
    """Choose slots by how well they tell the classes apart, then fit by accelerated gradient steps."""
    n, positive = len(y), float(y.sum())
    rate = np.clip(positive / max(n, 1), 1e-6, 1 - 1e-6)
    start = float(np.log(rate / (1 - rate)))
    if not 0 < positive < n:
        return Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(before.shape[1]), start)
    seen = np.bincount(slot, minlength=SLOTS)
    inside = np.bincount(slot[(y > 0)[row]], minlength=SLOTS)
    used = np.flatnonzero(seen)
    seen, inside = seen[used], inside[used]
    expected = seen * rate
    score = np.abs(inside - expected) / np.sqrt(expected * (1 - rate) + 1)
    best = np.sort(np.argsort(-score, kind="stable")[:CHOSEN])
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[used[best]] = np.arange(len(best))
    at = place[slot]
    r, f = row[at >= 0], at[at >= 0]
    w, g, b = np.zeros(len(best)), np.zeros(before.shape[1]), start
    vw, vg, vb = w.copy(), g.copy(), b
    # a step that each coordinate can bear: features of a row add up
    load = max(1.0, float(np.bincount(r, minlength=n).max(initial=0)) ** 0.5)
    step = 4.0 / load
    for i in range(rounds):
        p = _sigmoid(np.bincount(r, weights=vw[f], minlength=n) + before @ vg + vb)
        off = p - y
        common = np.sqrt(seen[best] / n)
        nw = vw - step * (np.bincount(f, weights=off[r], minlength=len(best)) / n / np.maximum(common, 0.01) + ridge * vw)
        ng = vg - step * (before.T @ off) / n
        nb = vb - step * off.mean()
        pull = i / (i + 3)
        vw, vg, vb = nw + pull * (nw - w), ng + pull * (ng - g), nb + pull * (nb - b)
        w, g, b = nw, ng, nb
    return Linear(used[best], w, g, float(b))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        row, slot = features(data, offsets, wanted)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.models)))
        for i, model in enumerate(self.models):
            out[:, i] = _sigmoid(model.margins(row, slot, n, out[:, :i]))
        return out

    def wanted(self) -> np.ndarray:
        keep = np.zeros(SLOTS, dtype=bool)
        for m in self.models:
            keep[m.slots] = True
        return keep


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best, in the middle of the gap and not below FLOOR; 0.5 if there is nothing to tell apart."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ends = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(ends, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(y) else 0.0
    return max(FLOOR, float((p[order][k] + below) / 2))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, y, text) to (id, y, slots)."""
    for batch in batches:
        for first, data, offsets in blocks(batch.column("text")):
            row, slot = features(data, offsets)
            n = len(offsets) - 1
            at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, n), batch.column("y").slice(first, n), lists], names=["id", "y", "slots"])


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, str] = CATEGORIES,
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    folds: int = FOLDS,
) -> Chain:
    """Fit the chain in the order of `categories`, SQL expressions over `labels` that give 0 or 1.

    At most `sample` labelled rows are used, those with the least hash of their key; this is the only bound. Labels that are
    null in any category, or whose document is missing, are left out. Without usable rows, or with one class only, a
    model gives the share of positives everywhere.
    """
    y = F.array(*[F.expr(e).cast("double") for e in categories.values()])
    drawn = labels.select(col(key).alias("k"), y.alias("y")).where("NOT exists(y, v -> v IS NULL) AND k IS NOT NULL")
    drawn = drawn.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    # `sample` rows at most
    joined = docs.select(col(key).alias("id"), col(text).cast("binary").alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("k"))
    kind = joined.dtypes[0][1]
    rows = joined.select("id", "y", "text").mapInArrow(_gather, f"id {kind}, y array<double>, slots array<int>")
    # a repeated document would add to the bound
    got = rows.withColumn("h", F.xxhash64("id", "y", "slots")).orderBy("h").limit(sample).toArrow()
    n, names = len(got), list(categories)
    lists = got.column("slots").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    slot = lists.flatten().to_numpy() if n else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    hashed = np.array(got.column("h").to_pylist(), dtype=np.int64).view(np.uint64)
    truth = np.array(got.column("y").to_pylist(), dtype=float).reshape(n, len(names))
    del got, lists
    # what few documents have cannot be told from chance
    common = (np.bincount(slot, minlength=SLOTS) >= FEW)[slot] if n else np.zeros(0, dtype=bool)
    slot, row = slot[common], row[common]
    fold = (hashed % np.uint64(folds)).astype(int)
    apart = np.zeros((n, len(names)))  # out-of-fold probabilities
    models, thresholds = [], []
    for i in range(len(names)):
        before = apart[:, :i]
        for f in range(folds):
            train, held = fold != f, fold == f
            if not held.any() or not train.any():
                continue
            number = np.cumsum(train) - 1
            use = train[row]
            part = fit_linear(number[row[use]], slot[use], truth[train, i], before[train])
            number = np.cumsum(held) - 1
            use = held[row]
            apart[held, i] = _sigmoid(part.margins(number[row[use]], slot[use], int(held.sum()), before[held]))
        models.append(fit_linear(row, slot, truth[:, i], before))
        thresholds.append(_best_threshold(apart[:, i], truth[:, i]))
    return Chain(names, models, thresholds)


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add `p_<category>` and `is_<category>` for every category; a null text is empty.

    Columns of these names are replaced, all others are kept.
    """
    new = [f"p_{c}" for c in chain.names] + [f"is_{c}" for c in chain.names]
    kept = docs.select(*[col(c) for c in docs.columns if c.lower() not in new])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType() if c[:2] == "p_" else T.BooleanType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chain.wanted()
        for batch in batches:
            raw = batch.column(text).cast(pa.large_binary())
            parts = [chain.probabilities(data, offsets, wanted) for _, data, offsets in blocks(raw)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain.names)))
            columns = [pa.array(p[:, i]) for i in range(p.shape[1])]
            columns += [pa.array(p[:, i] >= chain.thresholds[i]) for i in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)
