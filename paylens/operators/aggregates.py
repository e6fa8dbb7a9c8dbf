"""Counts, means, medians, top-N lists and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, not_null, one_of, q
from paylens.operators.joins import topn_semi
from paylens.operators.quantiles import group_median, quantiles_of_counts, value_counts
from paylens.operators.stages import add_columns
from paylens.schema import CATEGORY_ORDER
from paylens.sources.literals import literal_table

# Attributes with many values, shown for their most frequent values only; and
# attributes shown in the order of their keys.
WIDE_ATTRIBUTES = ("Undergraduate School", "Graduate School", "Location")
KEY_ORDERED_ATTRIBUTES = ("Age", "Job Satisfaction")


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """Aggregates per group, each an SQL expression; rows with a null key are left out."""
    return (
        df.where(not_null(keys))
        .groupBy(*[q(k) for k in keys])
        .agg(*[F.expr(f"{e} AS {q(out)}") for out, e in aggregates.items()])
    )


def count_by_group(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return aggregate(df, keys, {out: "count(*)"})


def mean_by_group(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    return aggregate(df, keys, {out: f"avg({q(value)})"})


def mean_count_by_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of a column and number of rows per group."""
    return aggregate(df, keys, {"mean": f"avg({q(value)})", "n": "count(*)"})


def median_where(
    df: DataFrame, column: str, wanted: str, by: str, value: str, out: str = "median"
) -> DataFrame:
    """Median per period for the rows with one value of a column, or for "All" rows."""
    rows = df if wanted == "All" else df.where(f"{q(column)} = {lit(wanted)}")
    return group_median(rows, [by], value, out)


def topn_values(df: DataFrame, column: str, n: int, seq: str) -> DataFrame:
    """The N most frequent values; among equal counts the value seen first wins."""
    counted = aggregate(df, [column], {"n": "count(*)", "first_seen": f"min({q(seq)})"})
    return counted.orderBy(F.desc("n"), "first_seen").limit(n)


def category_rank(expr: str, order: Sequence[str]) -> str:
    """Place of a value in an explicit list, from 1; null for values not in it."""
    return f"nullif(array_position(array({', '.join(lit(v) for v in order)}), {expr}), 0)"


def profile_by_attribute(
    df: DataFrame,
    column: str,
    feature: str,
    seq: str,
    n: int = 20,
    measure: str = "Salary",
    satisfaction: str = "Job Satisfaction",
    wide: Sequence[str] = WIDE_ATTRIBUTES,
    key_ordered: Sequence[str] = KEY_ORDERED_ATTRIBUTES,
    orders: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Count, median pay or mean satisfaction per value of an attribute, in display order.

    `feature` is "count", "median" or "mean". Wide attributes keep their N most frequent values.
    """
    rows = df
    if column in wide:
        rows = topn_semi(df, topn_values(df, column, n, seq), column)
    if feature == "count":
        table = count_by_group(rows, [column], "value")
    elif feature == "median":
        table = group_median(rows, [column], measure, "value")
    elif feature == "mean":
        table = mean_by_group(rows, [column], satisfaction, "value")
    else:
        raise ValueError(f"unknown feature {feature!r}")
    order = (orders or {"Years of Experience": CATEGORY_ORDER["Years of Experience"]}).get(column)
    if order:
        return table.orderBy(F.expr(category_rank(q(column), order)).asc_nulls_last(), q(column))
    if column in key_ordered:
        return table.orderBy(q(column))
    return table.orderBy("value", q(column))


def topn_median_trend(
    df: DataFrame, column: str, period: str, measure: str, seq: str, n: int = 15
) -> DataFrame:
    """Median per period of the N most frequent values, with the median over all periods."""
    rows = topn_semi(df, topn_values(df, column, n, seq), column)
    # a period that is null has no trend, but its answers are in the median over all; inside a struct it is a key like
    # any other, and comes out of a generator, so that both medians share one set of counts
    keyed = rows.selectExpr(q(column), f"named_struct('p', {q(period)}) AS _key", f"{q(measure)} AS _measure")
    counts = value_counts(keyed, [column, "_key"], "_measure")
    trend = quantiles_of_counts(counts, [column, "_key"], {"median": 0.5}).selectExpr(
        q(column), f"inline(array(named_struct({lit(period)}, _key.p, 'median', median)))"
    )
    trend = trend.where(not_null([period]))
    # the counts of all periods stand side by side; at most N rows
    overall = quantiles_of_counts(counts, [column], {"overall_median": 0.5})
    return trend.join(F.broadcast(overall), column).orderBy(F.desc("overall_median"), q(column), q(period))


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """"All" followed by the distinct values of a column."""
    values = df.selectExpr(f"CAST({q(column)} AS STRING) AS option").distinct()
    return literal_table(df.sparkSession, [("All",)], "option string").unionByName(values)


def pivot_matrices(
    df: DataFrame, row: str, column: str, columns: Sequence[str], mean_of: str, median_of: str
) -> DataFrame:
    """Three matrices side by side: mean_*, median_* and count_* for each listed column value.

    Empty cells are 0 in the counts and null elsewhere, and so is the whole line of a row whose answers are
    all outside the list or null. The list is given, so no job looks for it.
    """
    listed = f"CASE WHEN {one_of(q(column), columns)} THEN {q(column)} END AS {q(column)}"
    numbers = [f"{q(mean_of)} AS _mean_of", f"{q(median_of)} AS _median_of"]
    known = df.where(not_null([row])).selectExpr(q(row), listed, *numbers)
    cells = known.groupBy(q(row), q(column)).agg(F.expr("avg(_mean_of) AS mean"), F.expr("count(_mean_of) AS count"))
    medians = group_median(known, [row, column], "_median_of", "median")
    wide = (
        cells.join(medians, [row, column], "left")
        .groupBy(q(row))
        .pivot(q(column), list(columns))
        .agg(*[F.expr(f"first({m}) AS {m}") for m in ("mean", "median", "count")])
    )
    return wide.selectExpr(
        q(row),
        *[f"{q(f'{v}_mean')} AS {q(f'mean_{v}')}" for v in columns],
        *[f"{q(f'{v}_median')} AS {q(f'median_{v}')}" for v in columns],
        *[f"coalesce({q(f'{v}_count')}, 0L) AS {q(f'count_{v}')}" for v in columns],
    )


def pivot_long_wide(df: DataFrame, index: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    """Long to wide for a table with one row per (index, column)."""
    return df.groupBy(q(index)).pivot(q(column), list(columns)).agg(F.expr(f"first({q(value)})"))


def count_band(table: DataFrame, series: str, mean: str = "mean", count: str = "n", width: float = 5.0) -> DataFrame:
    """Band around a mean: counts scaled so that the largest of its series is `width` wide.

    The input is an aggregated table, one row per point of a series.
    """
    peak = f"max({q(count)}) OVER (PARTITION BY {q(series)})"
    scaled = add_columns(table, {"thickness": f"{q(count)} / {peak} * {lit(float(width))}"})
    return add_columns(
        scaled, {"low": f"{q(mean)} - thickness / 2", "high": f"{q(mean)} + thickness / 2"}
    )
