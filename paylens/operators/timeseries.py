"""Economic series: gaps, latest values, yearly values, growth, inflation adjustment.

A series has one row per date, so a window over one series sees as many rows as the calendar
has periods, whatever the size of the survey.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import let, q
from paylens.operators.joins import lookup_join
from paylens.operators.stages import add_columns


def interpolate_gaps(series: DataFrame) -> DataFrame:
    """Fill missing values linearly by row position within each series.

    Gaps before the first value stay null; gaps after the last one repeat it.
    """
    by_date = "PARTITION BY series_id ORDER BY date"
    around = {
        "_prev": f"last_value(_known) IGNORE NULLS OVER ({by_date} ROWS UNBOUNDED PRECEDING)",
        "_next": f"first_value(_known) IGNORE NULLS OVER ({by_date} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    }
    line = "_prev.v + (_next.v - _prev.v) / (_next.pos - _prev.pos) * (_pos - _prev.pos)"
    placed = add_columns(series, {"_pos": f"row_number() OVER ({by_date})"})
    known = add_columns(placed, {"_known": "CASE WHEN value IS NOT NULL THEN named_struct('pos', _pos, 'v', value) END"})
    filled = f"""CASE WHEN value IS NOT NULL OR _prev IS NULL THEN value
        WHEN _next IS NULL THEN _prev.v ELSE {line} END"""
    return add_columns(add_columns(known, around), {"value": filled}).select(*[q(c) for c in series.columns])


def interpolate_long(series: DataFrame, order: str = "date", segments: int | None = None) -> DataFrame:
    """interpolate_gaps for series of any length: no task holds more than a segment of one.

    Approximate quantiles of the order column cut all series into segments, as literals of the plan. Segments are
    worked on side by side; the rows before a segment, the last known value before it and the next behind it come from one small row
    per segment. `order` is a date, timestamp or number, unique in a series; rows whose order is null come first.
    """
    if segments is None:
        segments = 4 * int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = "double" if dict(series.dtypes)[order] not in ("date", "timestamp") else "timestamp"
    time = f"CAST(CAST({q(order)} AS {number}) AS DOUBLE)"
    steps = ", ".join(f"{i / segments}D" for i in range(1, segments))
    cuts = sorted(set(series.selectExpr(f"percentile_approx({time}, array({steps}), 10000) AS c").first()["c"] or [])) if segments > 1 else []
    segment = _cuts_up_to(time, cuts) if cuts else "0"
    here = f"PARTITION BY series_id, _seg ORDER BY {q(order)}"
    cut = series.selectExpr("*", f"CASE WHEN {q(order)} IS NULL THEN -1 ELSE {segment} END AS _seg")
    placed = cut.selectExpr("*", f"row_number() OVER ({here}) AS _row")
    known = placed.selectExpr("*", "CASE WHEN value IS NOT NULL THEN named_struct('pos', _row, 'v', value) END AS _known")
    ends = known.groupBy(F.col("series_id").alias("_id"), F.col("_seg").alias("_s")).agg(
        F.expr("count(*) AS _n"), F.expr("max_by(_known, _row) FILTER (WHERE _known IS NOT NULL) AS _last"), F.expr("min_by(_known, _row) FILTER (WHERE _known IS NOT NULL) AS _first")
    )
    before, behind = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    by = "PARTITION BY _id ORDER BY _s"
    started = ends.selectExpr("*", f"coalesce(sum(_n) OVER ({by} {before}), 0L) AS _start")
    moved = "CASE WHEN {0} IS NOT NULL THEN named_struct('pos', {0}.pos + _start, 'v', {0}.v) END AS {0}".format
    started = started.selectExpr("_id", "_s", "_start", moved("_last"), moved("_first"))
    carried = started.selectExpr(
        "_id", "_s", "_start",
        f"last_value(_last) IGNORE NULLS OVER ({by} {before}) AS _before", f"first_value(_first) IGNORE NULLS OVER ({by} {behind}) AS _behind",
    )
    joined = known.join(carried, F.expr("series_id <=> _id AND _seg = _s"))
    moved = "CASE WHEN _known IS NOT NULL THEN named_struct('pos', _row + _start, 'v', value) END"
    joined = joined.selectExpr("*", "_row + _start AS _pos", f"{moved} AS _at")
    # by the row's number: rows of the same order value stay in the order in which they were numbered, however the join ran
    here = "PARTITION BY series_id, _seg ORDER BY _row"
    around = joined.selectExpr(
        "*",
        f"coalesce(last_value(_at) IGNORE NULLS OVER ({here} ROWS UNBOUNDED PRECEDING), _before) AS _prev",
        f"coalesce(first_value(_at) IGNORE NULLS OVER ({here} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), _behind) AS _next",
    )
    line = "_prev.v + (_next.v - _prev.v) / (_next.pos - _prev.pos) * (_pos - _prev.pos)"
    filled = f"CASE WHEN value IS NOT NULL OR _prev IS NULL THEN value WHEN _next IS NULL THEN _prev.v ELSE {line} END AS value"
    return around.selectExpr(*[filled if c == "value" else q(c) for c in series.columns])


def _cuts_up_to(e: str, cuts: Sequence[float]) -> str:
    """How many of the sorted cut points are at most `e`, found by halving: each row looks at the logarithm of their number."""
    listed = ", ".join(f"{c!r}D" for c in cuts)
    steps = ", ".join(str(1 << i) for i in reversed(range(len(cuts).bit_length())))
    halved = "aggregate(steps, 0, (n, step) -> CASE WHEN get(cuts, n + step - 1) <= t THEN n + step ELSE n END)"
    return let(e, "t", let(f"array({listed})", "cuts", let(f"array({steps})", "steps", halved)))


def latest_value(series: DataFrame) -> DataFrame:
    """Date and value of the last observation that has one, per series."""
    return (
        series.where("value IS NOT NULL")
        .groupBy("series_id")
        .agg(F.expr("max_by(value, date) AS value"), F.expr("max(date) AS date"))
    )


def since(series: DataFrame, start: str, column: str = "date") -> DataFrame:
    return series.where(f"{q(column)} >= DATE'{start}'")


def resample_year_last(series: DataFrame) -> DataFrame:
    """Last observation with a value of each year, with its date; a year without one gives null."""
    observed = "CASE WHEN value IS NOT NULL THEN date END"
    return series.groupBy("series_id", F.expr("year(date) AS year")).agg(
        F.expr(f"max_by(value, {observed}) AS value"), F.expr(f"max({observed}) AS observed")
    )


def growth_vs_base(yearly: DataFrame, value: str = "value", out: str = "growth_pct") -> DataFrame:
    """Percent growth against the first year of each series."""
    base = f"first_value({q(value)}) OVER (PARTITION BY series_id ORDER BY year ROWS UNBOUNDED PRECEDING)"
    return add_columns(yearly, {out: f"({q(value)} / {base} - 1) * 100"})


def compare_growth(tables: Sequence[DataFrame]) -> DataFrame:
    """Growth of several yearly series (series_id, year, value) as one long table."""
    one = reduce(lambda a, b: a.unionByName(b), [t.select("series_id", "year", "value") for t in tables])
    return growth_vs_base(one)


def append_missing_periods(series: DataFrame, extra: DataFrame) -> DataFrame:
    """Add hand-made rows for dates a series lacks; a row of the series itself always wins."""
    missing = extra.join(series.select("series_id", "date"), ["series_id", "date"], "left_anti")
    return series.unionByName(missing.select(*series.columns))


def current_value(index: DataFrame) -> Column:
    """Latest value of a single series as a scalar."""
    return latest_value(index).selectExpr("max(value)").scalar()


def join_month_fallback(facts: DataFrame, index: DataFrame, month: str, out: str) -> DataFrame:
    """Index value of each row's month; months after the last one take the latest value.

    `index` is one series. Months before its first value stay null. The index has one row per
    calendar month, hence the broadcast.
    """
    latest = latest_value(index).selectExpr("max(named_struct('date', date, 'value', value))").scalar()
    by_month = index.selectExpr(f"date AS {q(month)}", f"value AS {q(out)}")
    joined = lookup_join(facts, by_month, month, bounded=True).withColumn("_latest", latest)
    later = f"CASE WHEN {q(month)} > _latest.date THEN _latest.value END"
    return add_columns(joined, {out: f"coalesce({q(out)}, {later})"}).drop("_latest")


def inflation_adjust(facts: DataFrame, amount: str, index: str, current: Column, out: str) -> DataFrame:
    """Amounts in today's money, half-even to whole hundreds."""
    ratio = facts.withColumn("_now", current)
    adjusted = f"bround(CAST({q(amount)} AS DOUBLE) * (_now / {q(index)}), -2)"
    return add_columns(ratio, {out: adjusted}).drop("_now")
