"""Running totals inside groups of any size, without a task that holds a whole group.

Rows are ordered by a hexadecimal hash key. The first digits of the key cut each group into
4096 chunks; chunk totals give each chunk's start, and a window inside the chunk gives the rest. A
group with a third of all rows is therefore spread over 4096 windows.

Equal rows share a key, so its digits cannot part them. Where more than `EQUAL` rows agree, they come last in
their chunk and are dealt to 4096 parts of their own, which are chunks like the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.llm.tables import col, fresh
from paylens.session import stored

CHUNK_DIGITS = 3
PARTS = 4096
# as many rows of one group, key and amount may stand in one window
EQUAL = 4096


def equal_rows(slim: DataFrame, group: str, key: str, amount: str) -> DataFrame:
    """(g, k, a) of rows that occur more than `EQUAL` times, stored: at most rows / `EQUAL` entries.

    Copies are combined in their task before the shuffle.
    """
    counted = slim.groupBy(col(group).alias("g"), col(key).alias("k"), col(amount).alias("a")).agg(F.count(F.lit(1)).alias("copies"))
    return stored(counted.where(F.col("copies") > EQUAL).drop("copies"))


def running_total(
    rows: DataFrame, slim: DataFrame, group: str, key: str, amount: str, out: str, equal: DataFrame | None = None
) -> DataFrame:
    """Add `out`: the sum of `amount` up to and including a row, in an order of its group by key.

    `slim` holds group, key and amount of the same rows and is read for the chunk totals, so that
    a caller can hand in a stored, narrow copy. Null is a group of its own. Rows with the same key
    and amount are counted in an arbitrary order among themselves, so the totals of such rows together are always
    the same. `equal` is `equal_rows` of the same rows, for callers that need more than one total; those rows, if
    any, are stored with their parts, so that a task that runs again finds each row where it was.
    """
    equal = equal_rows(slim, group, key, amount) if equal is None else equal
    chunk, tag, part, start, g2, c2, t2, p2 = fresh(rows, "_chunk", "_tag", "_part", "_start", "_group2", "_chunk2", "_tag2", "_part2")
    digits = F.substring(col(key), 1, CHUNK_DIGITS)
    cut = rows.withColumn(chunk, digits)
    narrow = slim.select(col(group).alias(g2), digits.alias(c2), col(amount).alias(start))
    at, there = [chunk], [c2]
    if not equal.isEmpty():
        at, there = [chunk, tag, part], [c2, t2, p2]
        named = equal.toDF(g2, t2, p2)
        same = col(group).eqNullSafe(F.col(g2)) & (col(key) == F.col(t2)) & (col(amount) == F.col(p2))
        nowhere = [F.lit("").alias(tag), F.lit(0).cast("long").alias(part)]
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS).cast("long"))
        repeated = cut.join(named, same, "left_semi").withColumn(tag, F.concat_ws(":", col(key), col(amount))).withColumn(part, dealt)
        repeated = stored(repeated)
        cut = cut.join(named, same, "left_anti").select("*", *nowhere).unionByName(repeated)
        single = slim.join(named, same, "left_anti").select(col(group).alias(g2), digits.alias(c2), *nowhere, col(amount).alias(start))
        narrow = single.union(repeated.select(col(group), chunk, tag, part, col(amount))).toDF(g2, *there, start)
    totals = narrow.groupBy(g2, *there).agg(F.sum(start).alias(start))
    before = W.partitionBy(g2).orderBy(*there).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(g2, *there, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    meet = col(group).eqNullSafe(F.col(g2))
    for here, other in zip(at, there):
        meet = meet & (F.col(here) == F.col(other))
    inside = W.partitionBy(g2, *there).orderBy(col(key), col(amount)).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.join(starts, meet, "left")
        .withColumn(out, (F.col(start) + F.sum(col(amount)).over(inside)).cast("long"))
        .drop(*at, start, g2, *there)
    )
