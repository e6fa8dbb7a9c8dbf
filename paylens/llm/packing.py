"""Packing into length buckets whose boundaries are optimal for the corpus.

The histogram of all lengths goes through a dynamic programme that chooses at most `buckets`
boundaries with the least padding. Inside a bucket, documents in shuffled order fill batches of equal
height: as many rows as the token budget holds at the bucket's boundary.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.prefix import running_total
from paylens.llm.tables import col, fresh, row_key, word_count
from paylens.session import stored

BUCKETS = 24
BUDGET = 32768
# lengths share a cell of the histogram if they agree in their first so many binary digits
DIGITS = 7


def _cell(length: Column) -> Column:
    """Histogram cell of a length: exact below 2 ** DIGITS, then 64 cells to each doubling.

    At most 64 cells for each of the 63 doublings of a long, however many lengths there are.
    """
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(length)) - DIGITS))
    return (F.floor(length / step) * step).cast("long")


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], sums: Sequence[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` runs of cells such that the padding is least.

    `lengths` are the cells' greatest lengths, ascending. cost(i, j) = the cells i to j padded to the
    length of j; least[j] is the best cost of cells 0 to j with the buckets so far. A new bucket
    never costs, so the last round is the best.
    """
    top = np.asarray(lengths, dtype=np.float64)
    n = len(top)
    if not n:
        return []
    count = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    total = np.concatenate([[0.0], np.cumsum(np.asarray(sums, dtype=np.float64))])
    least = top * count[1:] - total[1:]
    cuts = []
    for _ in range(1, min(buckets, n)):
        before = np.concatenate([[0.0], least[:-1]])  # cost of all cells before i
        new, cut = np.empty(n), np.empty(n, dtype=np.int64)
        for j in range(n):
            cost = before[: j + 1] + top[j] * (count[j + 1] - count[: j + 1]) - (total[j + 1] - total[: j + 1])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        least = new
        cuts.append(cut)
    ends, j = [], n - 1
    for cut in reversed(cuts):
        ends.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            return sorted(ends)
    return sorted([*ends, int(lengths[j])])


def boundaries(lengths: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    """Optimal boundaries for a column of lengths; the histogram has a few thousand cells at most."""
    cells = lengths.groupBy(_cell(col(length)).alias("cell")).agg(
        F.max(col(length)).alias("top"), F.count(F.lit(1)).alias("n"), F.sum(col(length)).alias("total")
    )
    got = sorted((r["top"], r["n"], r["total"]) for r in cells.collect())
    return best_boundaries(*zip(*got), buckets) if got else []


def pack(
    docs: DataFrame,
    text: str = "text",
    length: Column | None = None,
    identity: Sequence[str] = ("doc_id", "text"),
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: int = 10,
) -> DataFrame:
    """Every document with `length`, `bucket`, `boundary`, `batch`, `slot` and `padding`.

    `length` is the number of words plus an end mark unless another expression is given. `batch` counts
    from 0 inside `bucket`, `slot` inside the batch; a batch holds max(1, budget / boundary) documents,
    and only the last one of a bucket may hold fewer. A document longer than the budget fills a batch of
    its own. A null text has length 1 (the end mark); a null given length counts as 0. Equal rows are
    separate documents. Columns of these six names in the input are replaced, all others are kept.
    """
    measure = F.coalesce(length, F.lit(0)).cast("long") if length is not None else word_count(col(text)) + 1
    key, n, one, nth, b = fresh(docs, "_key", "_length", "_one", "_nth", "_bucket")
    rows = docs.withColumn(n, measure).withColumn(key, row_key(docs, seed, identity)).withColumn(one, F.lit(1).cast("long"))
    slim = stored(rows.select(n, key))
    ends = boundaries(slim, n, buckets) or [1]
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    place = (F.size(bounds) - F.size(F.filter(bounds, lambda e: e >= F.col(n)))).cast("int")
    rows = rows.withColumn(b, place)
    counted = running_total(
        rows, slim.withColumn(b, place).withColumn(one, F.lit(1).cast("long")).select(b, key, one), b, key, one, nth
    )
    boundary = F.element_at(bounds, F.col(b) + 1)
    height = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / boundary))
    replaced = ["length", "bucket", "boundary", "batch", "slot", "padding"]
    return counted.select(
        *[col(c) for c in docs.columns if c.lower() not in replaced],
        F.col(n).alias("length"),
        F.col(b).alias("bucket"),
        boundary.alias("boundary"),
        F.floor((F.col(nth) - 1) / height).cast("long").alias("batch"),
        ((F.col(nth) - 1) % height).cast("long").alias("slot"),
        (boundary - F.col(n)).alias("padding"),
    )
