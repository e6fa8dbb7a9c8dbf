"""Mixing sources to target weights by weighted fair queueing.

Every document has a place in its source's shuffled order. Its virtual finish time is the number
of words its source has served up to it, divided by the source's target; a source that must be repeated
goes on for up to three rounds. All (document, round) pairs are put in order of finish time and
cut where the total budget is used up, so every source advances at its own rate at any point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paylens.llm.prefix import equal_rows, running_total
from paylens.llm.tables import col, fresh, row_key, word_count
from paylens.session import stored

ROUNDS = 3
WEIGHTS = (1, 2, 3)
# finish times fall into so many bins, of which only the one at the cut is sorted in one place
BINS = 16384


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(src, source_size) to (src, source_size, rank, target), all sources sharing the total by weight.

    Sources are numbered by code point, null last, and weigh `weights` in turn. A target ends at
    `rounds` times the size; what is left over goes to the others by weight until none is above.
    Sources reach their ceiling in order of ceiling / weight, so one pass over that order finds the
    level: the first that fits, which is the highest, as each further source at its ceiling lowers it. One row per source: a table of sources, not of documents, is what meets in one task.
    """
    by_name = W.orderBy(F.col("src").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = (
        sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", turn.cast("double"))
        .withColumn("ceiling", F.col("source_size").cast("double") * rounds)
    )
    order = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("rank"))
    below = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    left = total - F.coalesce(F.sum("ceiling").over(below), F.lit(0.0))
    # water level if exactly the sources before this one are at their ceiling
    leveled = ranked.withColumn(
        "level", left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    )
    fits = F.when(F.col("level") <= F.col("ceiling") / F.col("weight"), F.col("level"))
    return leveled.withColumn("level", F.max(fits).over(every)).select(
        "src",
        "source_size",
        "rank",
        F.least(F.col("ceiling"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def _bin(finish: Column) -> Column:
    """Finish times from 0 to infinity to bin numbers, in the same order."""
    return F.floor(finish / (finish + 1) * BINS).cast("int")


def _rounds(total: Column, size: Column, target: Column, rounds: int) -> Column:
    """(finish, round) of one document in each round it may be taken in."""
    each = [F.struct(((total + size * i) / target).alias("finish"), F.lit(i).alias("round")) for i in range(rounds)]
    return F.when(target > 0, F.array(*each)).otherwise(F.array().cast("array<struct<finish:double,round:int>>"))


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    identity: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[int] = WEIGHTS,
    rounds: int = ROUNDS,
    seed: int = 8,
) -> DataFrame:
    """Every document with `size`, `source_size`, `target`, `copies` and `finish` (null if not taken).

    `copies` (0 to `rounds`) says how often the mix takes it, `finish` is its first finish time. A
    null text has no words and a null source is a source of its own, the last. Documents without words may be
    taken, they cost nothing; if no source has words nothing is taken. Equal rows are
    separate documents. Columns of these five names in the input are replaced; all others are kept.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "finish")
    key, src, rank, total, size = fresh(docs, "_key", "_src", "_rank", "_total", "_size")
    rows = docs.withColumn(size, word_count(col(text))).withColumn(key, row_key(docs, seed, identity))
    slim = stored(rows.select(col(source).cast("string").alias("g"), F.col(key).alias("k"), F.col(size).alias("n")))
    sizes = slim.groupBy(F.col("g").alias("src")).agg(F.sum("n").alias("source_size"))
    targets = stored(source_targets(sizes, weights, rounds))
    equal = equal_rows(slim, "g", "k", "n")

    def placed(df: DataFrame, group: str, k: str, n: str) -> DataFrame:
        """Running totals inside the source, and the source's target."""
        here = running_total(df, slim.select(F.col("g").alias(group), F.col("k").alias(k), F.col("n").alias(n)), group, k, n, total, equal)
        there = targets.select(F.col("src").alias(src), F.col("rank").alias(rank), "source_size", "target")
        return here.join(there, col(group).eqNullSafe(F.col(src)), "left").drop(src)

    def events(df: DataFrame, n: str) -> Column:
        return _rounds(F.col(total), F.col("source_size"), F.col("target"), rounds)

    narrow = placed(slim, "g", "k", "n")
    shown = stored(
        narrow.select("k", "n", F.col(rank).alias("rank"), F.explode(events(narrow, "n")).alias("e")).select(
            "k", "n", "rank", "e.finish", "e.round", _bin(F.col("e.finish")).alias("bin")
        )
    )
    budget = targets.select(F.sum("source_size")).scalar()
    binned = shown.groupBy("bin").agg(F.sum("n").alias("words"))
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cut_bins = binned.select("bin", "words", F.sum("words").over(upto).alias("upto")).where(F.col("upto") > budget)
    # one row: the first bin that the budget does not cover, and the words before it
    first = cut_bins.select(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base")))).scalar()
    at_cut = shown.where(F.col("bin") == first["bin"])
    order = W.orderBy("finish", "rank", "round", "k", "n").rowsBetween(W.unboundedPreceding, 0)
    fits = at_cut.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= budget - first["base"])
    # one row: the last place that fits, and the bin of the cut; all bins fit if the first is null
    last = stored(fits.select(F.max(F.struct("finish", "rank", "round", "k")).alias("last")).withColumn("bin", first["bin"]))

    full = placed(rows, source, key, size)
    end_, cut_, taken_ = fresh(full, "_end", "_cut", "_taken")
    full = full.withColumn(end_, last.select("last").scalar()).withColumn(cut_, last.select("bin").scalar())
    end, cut = F.col(end_), F.col(cut_)
    inside = lambda e: (
        cut.isNull()
        | (_bin(e["finish"]) < cut)
        | (
            (_bin(e["finish"]) == cut)
            & (F.struct(e["finish"].alias("finish"), F.col(rank).alias("rank"), e["round"].alias("round"), F.col(key).alias("k")) <= end)
        )
    )
    taken = F.filter(events(full, size), lambda e: F.coalesce(inside(e), F.lit(False)))
    return (
        full.withColumn(taken_, taken)
        .withColumn("copies", F.size(taken_))
        .withColumn("finish", F.when(F.size(taken_) > 0, F.col(taken_)[0]["finish"]))
        .withColumn("size", F.col(size))
        .drop(key, rank, total, size, end_, cut_, taken_)
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", identity: Sequence[str] = ("doc_id", "text"), **options
) -> DataFrame:
    """The mix itself, with the columns of `docs`: each document as often as it is taken, in parts sorted by finish time."""
    names = [f"_identity{i}" for i in range(len(identity))]
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("_doc"),
        col(text).alias("_text"),
        col(source).alias("_source"),
        *[col(c).alias(n) for c, n in zip(identity, names)],
    )
    planned = plan_mix(rows, "_text", "_source", names, **options).where("copies > 0")
    repeated = planned.select("_doc", "finish", "source_size", "target", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("again"))
    timed = repeated.select("_doc", (F.col("finish") + F.col("again") * F.col("source_size") / F.col("target")).alias("_time"))
    return timed.repartitionByRange("_time").sortWithinPartitions("_time").select("_doc.*")
