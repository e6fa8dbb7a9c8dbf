"""Lookups in dimension tables that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import not_null, q
from paylens.operators.stages import add_columns
from paylens.session import stored
from paylens.sources.literals import literal_table

# a dimension is broadcast if it has at most so many rows and bytes
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
SHARES = 64
HOT_ONE_IN = 1000
_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def share_of(columns: Sequence[str], shares: int) -> str:
    """Number of a share, from 0, by a hash of columns.

    Never null, and declared so: a null check would be pushed below into one branch of a plan and
    keep it from sharing a shuffle with another.
    """
    return f"coalesce(CAST(pmod(xxhash64({', '.join(q(c) for c in columns)}), {shares}) AS INT), 0)"


@dataclass(frozen=True)
class HotKeys:
    """Keys that hold many rows with the shares each is split into, and the shares of the rows without a key."""

    table: DataFrame
    null_shares: int


def hot_keys(facts: DataFrame, on: Sequence[str], one_in: int = HOT_ONE_IN, tasks: int | None = None) -> HotKeys:
    """Keys with more than one in `one_in` of all rows, and the shares each is split into; null may have any number of rows.

    One pass over the key columns, made when this is called: counts per key are stored, and the few hot
    ones come back as a literal table that any number of joins can use. A key gets a share for
    every `1 / tasks` of the rows that it holds, twice over; `tasks` is the number of shuffle partitions unless given.
    """
    spark = facts.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(facts.groupBy(*[q(k) for k in on]).agg(F.expr("count(*) AS _n")))
    given = not_null(on)
    rows, nulls = counted.selectExpr("coalesce(sum(_n), 0L)", f"coalesce(sum(CASE WHEN NOT ({given}) THEN _n END), 0L)").first()
    shares = f"CAST(ceil(2 * {{}} * {tasks} / {rows or 1}) AS INT) + 1".format
    # fewer than one_in rows
    hot = counted.where(f"{given} AND _n > {rows} / {one_in}").selectExpr(*[q(k) for k in on], f"{shares('_n')} AS _shares")
    ddl = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in hot.schema.fields)
    table = literal_table(spark, [tuple(r) for r in hot.collect()], ddl)
    return HotKeys(table, -(-2 * nulls * tasks // (rows or 1)) + 1)


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    shares: int = SHARES,
    spread_by: Sequence[str] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Equi-join in which keys of `facts` are split over `shares` tasks.

    The share follows from a hash of the row, so a retried task sends each row the same way. The
    rows of `dim` are written once per share. With `hot` only its keys and null are split, each into its own number of
    shares, and only their rows of `dim` are repeated; without it all are.
    """
    spread = spread_by or facts.columns
    if hot is None:
        left = facts.selectExpr("*", f"{share_of(spread, shares)} AS _share")
        right = dim.selectExpr("*", f"explode(sequence(0, {shares - 1})) AS _share")
    else:
        flagged = F.broadcast(hot.table)  # fewer rows than HOT_ONE_IN
        number = f"pmod(xxhash64({', '.join(q(c) for c in spread)}), CAST(coalesce(_shares, {hot.null_shares}) AS BIGINT))"
        left = facts.join(flagged, list(on), "left").selectExpr(
            *[q(c) for c in facts.columns],
            f"CASE WHEN _shares IS NOT NULL OR NOT ({not_null(on)}) THEN CAST({number} AS INT) ELSE 0 END AS _share",
        )
        right = dim.join(flagged, list(on), "left").selectExpr(
            *[q(c) for c in dim.columns], "explode(sequence(0, coalesce(_shares, 1) - 1)) AS _share"
        )
    return left.join(right, [*on, "_share"], how).drop("_share")


def small_enough(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: counts rows, and bytes of texts, of at most max_rows + 1 rows."""
    wide = [f"coalesce(octet_length(CAST({q(c)} AS STRING)), 0)" for c, kind in dim.dtypes if kind not in _FIXED]
    size = " + ".join([str(16 * len(dim.columns)), *wide])
    rows, size = dim.limit(max_rows + 1).selectExpr("count(*)", f"coalesce(sum({size}), 0L)").first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    bounded: bool = False,
    hot: HotKeys | Callable[[], HotKeys] | None = None,
) -> DataFrame:
    """Join to a dimension: broadcast when its rows and bytes are known to be few, else salted.

    `bounded` skips the check where the row count has a ceiling by construction, such as the months of a
    calendar or a top-N list. Beyond that both sides are shuffled, and the keys that are hot in the facts are
    split. They are looked for in one pass over the keys, unless the caller hands in `hot` from an earlier one, or a
    function for it that several lookups share.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if bounded or small_enough(dim, max_rows):
        return facts.join(F.broadcast(dim), keys, how)
    if hot is None:
        hot = hot_keys(facts, keys)
    return salted_join(facts, dim, keys, how, hot=hot() if callable(hot) else hot)


def shared_hot_keys(facts: DataFrame, on: str | Sequence[str]) -> Callable[[], HotKeys]:
    """The hot keys for several lookups of the same facts: counted once, by the first lookup that needs them."""
    return cache(lambda: hot_keys(facts, [on] if isinstance(on, str) else list(on)))


def enrich_location(facts: DataFrame, coordinates: DataFrame, key: str = "Location", hot: HotKeys | Callable[[], HotKeys] | None = None) -> DataFrame:
    """Left join to the coordinate cache."""
    return lookup_join(facts, coordinates, key, hot=hot)


def unresolved_keys(facts: DataFrame, cache: DataFrame, key: str = "Location") -> DataFrame:
    """Distinct keys the cache lacks; made distinct first, so hot keys shrink before any shuffle."""
    keys = facts.select(q(key)).where(not_null([key])).distinct()
    return keys.join(cache, key, "left_anti")


def fill_from_gazetteer(
    facts: DataFrame,
    gazetteer: DataFrame,
    key: str = "Location",
    values: Sequence[str] = ("Latitude", "Longitude"),
    keep_missing: bool = False,
    hot: HotKeys | Callable[[], HotKeys] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fill values still missing from a second table: rows with coordinates, and the rest.

    With `keep_missing` the first table has all rows.
    """
    second = gazetteer.selectExpr(q(key), *[f"{q(v)} AS {q('_second_' + v)}" for v in values])
    joined = lookup_join(facts, second, key, hot=hot)
    filled = add_columns(joined, {v: f"coalesce({q(v)}, {q('_second_' + v)})" for v in values}).drop(
        *[f"_second_{v}" for v in values]
    )
    found = not_null([values[0]])
    return filled if keep_missing else filled.where(found), filled.where(f"NOT ({found})")


def topn_semi(facts: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among a top-N list; the list is at most N rows long."""
    return facts.join(F.broadcast(top.select(q(key))), key, "left_semi")
