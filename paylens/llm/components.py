"""Connected components by alternating stars, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.session import stored


def _toward_least(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Each edge (u, v) with the least v of its u; least by aggregate, so a hot u is combined before the shuffle."""
    least = edges.groupBy(F.col(u).alias("c")).agg(F.min(v).alias("least"))
    return edges.join(least, F.col(u) == F.col("c")).drop("c")


def _round(edges: DataFrame) -> DataFrame:
    """Edges (hi, lo). One large star and one small star; keeps the components, shortens the paths."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    large = (
        _toward_least(both, "u", "v")
        .where("v > u")
        .select(F.col("v").alias("hi"), F.least("u", "least").alias("lo"))
        .distinct()
    )
    down = _toward_least(large, "hi", "lo")
    small = down.where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return small.union(down.select("hi", F.col("least").alias("lo"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root) for every node that has a link; root is the least node reachable.

    Loops and links given twice or both ways do no harm, a link with a null is left out. Each round is written to the
    shared folder; only a count and a checksum come back. The rounds end when the edges no longer change,
    after a number that grows with the logarithm of the number of nodes.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = stored(_round(now))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
