"""Box-plot statistics, equal-width histograms and density curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, q
from paylens.operators.quantiles import SHIFTS, key_of, quantile_steps, value_counts


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str, deep: bool | None = None) -> DataFrame:
    """Quartiles per group and whiskers: the most extreme values within 1.5 quartile ranges.

    The cells that the quartiles were found with keep their least and greatest values, so whiskers come from these; only in
    the two cells of a group in which the limits lie are values looked at.
    """
    names = ", ".join(q(k) for k in keys)
    counts = value_counts(df, keys, value)
    steps = quantile_steps(counts, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, deep)
    low, high = (f"shiftright({key_of(limit)}, {SHIFTS[0]})" for limit in ("_low", "_high"))
    steps += [
        f"_box AS (SELECT {names}, q1, median, q3, _rows AS n, q1 - 1.5D * (q3 - q1) AS _low, q3 + 1.5D * (q3 - q1) AS _high FROM _picked)",
        f"_limits AS (SELECT *, {low} AS _first, {high} AS _last FROM _box)",
        f"_between AS (SELECT {names}, q1, median, q3, n, min(CASE WHEN _cell > _first THEN _lo END) AS _above,"
        f" max(CASE WHEN _cell < _last THEN _hi END) AS _below FROM _cells0 JOIN _limits USING ({names}) GROUP BY {names}, q1, median, q3, n)",
        f"_borders AS (SELECT {names}, _low, _high, explode(array_distinct(array(_first, _last))) AS _cell FROM _limits)",
        f"_edges AS (SELECT {names}, min(CASE WHEN _v >= _low THEN _v END) AS _from, max(CASE WHEN _v <= _high THEN _v END) AS _upto"
        f" FROM _rows0 JOIN _borders USING ({names}, _cell) GROUP BY {names})",
    ]
    return df.sparkSession.sql(
        f"WITH {', '.join(steps)} SELECT {names}, n, q1, median, q3, least(q1, _from, _above) AS whisker_low,"
        f" greatest(q3, _upto, _below) AS whisker_high FROM _between LEFT JOIN _edges USING ({names})",
        counts=counts,
    )


def numbers(df: DataFrame, value: str, below: float | None = None) -> DataFrame:
    """The values of a column as doubles named _v, null and NaN left out."""
    rows = df.selectExpr(f"CAST({q(value)} AS DOUBLE) AS _v").where("_v IS NOT NULL AND NOT isnan(_v)")
    return rows if below is None else rows.where(f"_v < {lit(float(below))}")


def value_span(rows: DataFrame) -> Column:
    """struct(lo, hi, n, std) of the values as a scalar subquery: one row, computed once."""
    facts = "named_struct('lo', min(_v), 'hi', max(_v), 'n', count(_v), 'std', stddev_samp(_v))"
    return rows.selectExpr(f"{facts} AS span").scalar()


def bin_of(v: str, lo: str, hi: str, bins: int) -> str:
    """Bin number of a value between lo and hi; each bin holds its left edge, the last one both.

    Rounding may put the quotient one off next to an edge, so the edges decide.
    """
    width = f"(({hi} - {lo}) / {bins})"
    guess = f"least(floor(({v} - {lo}) / {width}), {bins - 1}L)"
    down = f"CASE WHEN {v} < {lo} + {guess} * {width} THEN 1 ELSE 0 END"
    up = f"CASE WHEN {guess} < {bins - 1} AND {v} >= {lo} + ({guess} + 1) * {width} THEN 1 ELSE 0 END"
    return f"CAST({guess} - {down} + {up} AS BIGINT)"


def edges(lo: str, hi: str) -> tuple[str, str]:
    """Ends of a histogram: those given, or a range one unit wide around them where they are equal."""
    pad = f"CASE WHEN {lo} = {hi} THEN 0.5D ELSE 0D END"
    return f"({lo} - {pad})", f"({hi} + {pad})"


def with_all_bins(counted: DataFrame, bins: int) -> DataFrame:
    """All bin numbers, joined to the counts; both sides have as many rows as bins at most."""
    every = counted.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counted), "bin", "left")


def histogram_equal_width(df: DataFrame, value: str, bins: int, below: float | None = None) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value, empty bins included.

    A single value gets a range one unit wide around it.
    """
    rows = numbers(df, value, below)
    span = value_span(rows)
    ends = [f"{end} AS {name}" for end, name in zip(edges("_s.lo", "_s.hi"), ("_lo", "_hi"))]
    counted = (
        rows.withColumn("_s", span)
        .selectExpr("_v", *ends)
        .selectExpr(f"{bin_of('_v', '_lo', '_hi', bins)} AS bin")
        .groupBy("bin")
        .agg(F.expr("count(*) AS n"))
    )
    return (
        with_all_bins(counted, bins)
        .withColumn("_s", span)
        .selectExpr("bin", "n", *ends)
        .selectExpr(
            "bin",
            f"_lo + bin * ((_hi - _lo) / {bins}) AS left",
            f"_lo + (bin + 1) * ((_hi - _lo) / {bins}) AS right",
            "coalesce(n, 0L) AS n",
        )
    )


def density_curve(
    df: DataFrame, value: str, bins: int, points: int = 200, below: float | None = None
) -> DataFrame:
    """Gaussian density at equally spaced points, scaled to the counts of a histogram.

    Bandwidth after Scott. Each distinct value adds to the points within 39 bandwidths only: past
    that the exponential is zero in double precision, so nothing is left out. As the bandwidth
    shrinks with the number of rows, a value of a large table touches a few points. Values without
    spread, a single one among them, have no density: it is null at every point.
    """
    rows = numbers(df, value, below)
    span = value_span(rows)
    shape = [
        "_s.lo AS _lo",
        "nullif(_s.std * pow(_s.n, -0.2D), 0D) AS _h",
        f"nullif((_s.hi - _s.lo) / {points - 1}, 0D) AS _step",
        f"(_s.hi - _s.lo) / {bins} AS _width",
    ]
    summed = (
        rows.groupBy("_v")
        .agg(F.expr("count(*) AS _n"))
        .withColumn("_s", span)
        .selectExpr("_v", "_n", *shape)
        .selectExpr(
            "*",
            "greatest(ceil((_v - 39 * _h - _lo) / _step), 0L) AS _first",
            f"least(floor((_v + 39 * _h - _lo) / _step), {points - 1}L) AS _last",
        )
        # the outer form, and no filter: either would be pushed down and evaluated for every row
        # instead of every distinct value; a value between two points ends in the bin null, which
        # no point asks for
        .selectExpr("*", "explode_outer(CASE WHEN _first <= _last THEN sequence(_first, _last) END) AS bin")
        .groupBy("bin")
        .agg(F.expr("sum(_n * exp(-0.5D * pow((_lo + bin * _step - _v) / _h, 2D))) AS _sum"))
    )
    return (
        with_all_bins(summed, points)
        .withColumn("_s", span)
        .selectExpr("bin", "_sum", *shape)
        .selectExpr(
            "bin AS point",
            "_lo + bin * coalesce(_step, 0D) AS x",
            f"coalesce(_sum, 0D) / (_h * {lit(math.sqrt(2 * math.pi))}) * _width AS density",
        )
    )
