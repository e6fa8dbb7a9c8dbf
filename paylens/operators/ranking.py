"""Orders over the whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, q
from paylens.operators.aggregates import category_rank


def _cuts(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(columns, probs, 1 / (4 * buckets))
    return [sorted(set(c) - {float("inf"), float("-inf")}) for c in found]


def _slot(df: DataFrame, column: str, cuts: list[float], out: str) -> DataFrame:
    """Number of cuts that are not above the value."""
    if not cuts:
        return df.selectExpr("*", f"0 AS {out}")
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)


def rank_buckets(df: DataFrame, value: str, seq: str, ascending: bool, buckets: int) -> DataFrame:
    """Add _bucket and _part, which order rows roughly; within, the values themselves do.

    Approximate quantiles cut the values, and `seq`, into buckets of about equal size. They are a
    fixed number of literals in the plan, so every pass and retry sees the same buckets; only the
    balance depends on how good they are, never the order. A value so frequent that it is a cut
    itself gets a bucket of its own, split further by `seq`, and so does null; so no value makes a
    bucket large. Doubles only choose the bucket: whole numbers that share a double with a cut, but
    are less or more, go to the buckets beside the cut's own.
    """
    kind = df.selectExpr(f"{value} AS v").dtypes[0][1]
    back = f"try_cast(CAST({value} AS DOUBLE) AS {kind})"
    below, above = ("<", ">") if ascending else (">", "<")
    side = f"CASE WHEN {value} {below} {back} OR {back} IS NULL THEN 0 WHEN {value} {above} {back} THEN 2 ELSE 1 END"

    sign = "" if ascending else "-"
    work = df.selectExpr("*", f"nullif({sign}CAST({value} AS DOUBLE), double('NaN')) AS _v", f"CAST({q(seq)} AS DOUBLE) AS _s")
    v_cuts, s_cuts = _cuts(work, ["_v", "_s"], max(buckets, 2))
    work = _slot(_slot(work.selectExpr("*", "coalesce(_v, 0D) AS _o"), "_o", v_cuts, "_slot"), "_s", s_cuts, "_part")
    is_cut = "FALSE"
    if v_cuts:
        listed = ", ".join(lit(c) for c in v_cuts)
        is_cut = f"coalesce(get(array({listed}), CAST(_slot AS INT) - 1) = _o, FALSE)"
    return work.selectExpr("*", f"{is_cut} AS _cut").selectExpr(
        *[q(c) for c in df.columns],
        f"CASE WHEN _v IS NOT NULL THEN {value} END AS _o",
        # never null, and declared so, which spares a null check that would place each row twice
        f"coalesce(CAST(CASE WHEN _v IS NULL THEN {4 * len(v_cuts) + 8} WHEN _cut THEN 4 * _slot + {side} ELSE 4 * _slot + 3 END AS INT), 0) AS _bucket",
        f"coalesce(CAST(CASE WHEN _v IS NULL OR (_cut AND {side} = 1) THEN _part ELSE -1 END AS INT), 0) AS _part",
    )


def global_rank(
    df: DataFrame, value: str, seq: str, ascending: bool = True, buckets: int | None = None, out: str = "rank"
) -> DataFrame:
    """0-based place of every row by a number (null last), equal numbers by `seq`.

    `value` is an SQL expression, `seq` a unique numeric column; both are compared as what they are. The
    place is the number of rows in earlier buckets plus the row number within the bucket. Cutting
    the buckets takes one pass when this is called.
    """
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = rank_buckets(df, value, seq, ascending, buckets)
    # a few rows per bucket: these windows see buckets and parts, never data rows
    parts = work.groupBy("_bucket", "_part").agg(F.expr("count(*) AS _n"))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = (
        parts.groupBy("_bucket")
        .agg(F.expr("sum(_n) AS _n"))
        .selectExpr("_bucket", f"coalesce(sum(_n) OVER (ORDER BY _bucket {before}), 0L) AS _start")
    )
    offsets = (
        parts.selectExpr(
            "_bucket", "_part", f"coalesce(sum(_n) OVER (PARTITION BY _bucket ORDER BY _part {before}), 0L) AS _skip"
        )
        .join(starts, "_bucket")
        .selectExpr("_bucket", "_part", "_start + _skip AS _before")
    )
    order = f"_o {'ASC' if ascending else 'DESC'}, {q(seq)}"
    ranked = work.selectExpr("*", f"row_number() OVER (PARTITION BY _bucket, _part ORDER BY {order}) AS _row")
    return ranked.join(offsets, ["_bucket", "_part"]).selectExpr(
        *[q(c) for c in df.columns], f"CAST(_before + _row - 1 AS BIGINT) AS {q(out)}"
    )


def sort_key(column: str, orders: dict[str, list[str]], year: str = "Year") -> tuple[str, bool]:
    """What a listing is ordered by, and whether ascending: the year means order of entry, a
    category its explicit list, anything else the largest number first."""
    if column == year:
        return "0D", True
    if column in orders:
        return category_rank(q(column), orders[column]), True
    return q(column), False


def listing_order(
    df: DataFrame, column: str, seq: str, orders: dict[str, list[str]], year: str = "Year"
) -> DataFrame:
    """Rows in listing order: a range-partitioned sort of the whole table."""
    key, ascending = sort_key(column, orders, year)
    key = F.expr(key)
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), q(seq))


def sort_by_category(df: DataFrame, column: str, order: list[str], seq: str) -> DataFrame:
    """Rows by an explicit list of values, others last, ties in order of entry."""
    return listing_order(df, column, seq, {column: order}, year="")


def rank_grid(
    ranked: DataFrame, per_row: int, cell: float, x_offset: float = 0.0, y_offset: float = 0.0, rank: str = "rank"
) -> DataFrame:
    """Lay ranked rows out on a grid: column and row numbers and the centre of each cell."""
    placed = ranked.selectExpr("*", f"{q(rank)} % {per_row} AS grid_col", f"{q(rank)} DIV {per_row} AS grid_row")
    return placed.selectExpr(
        "*",
        f"grid_col * {lit(float(cell))} + {lit(float(x_offset))} AS cx",
        f"grid_row * {lit(float(cell))} + {lit(float(y_offset))} AS cy",
    )
