"""Economic series, inflation adjustment and literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.operators import timeseries as ts
from paylens.plans.growth import growth_table
from paylens.sources.literals import literal_table
from paylens.sources.series import as_series
from paylens.sources.series import inline_series as literal_series
from paylens.sources.survey import sheet_rows
from paylens.sources.survey import table_from_sheet as table_of_sheet
from paylens.workloads.views import (
    ADJUSTED_SQL,
    ALL_IDX_SQL,
    FILLED_SQL,
    IDX2_SQL,
    IDX_SQL,
    INDEX_END,
    R_SQL,
    adjusted_responses,
    monthly_index,
    responses,
    second_series,
    table,
)

_DAY = "date_format(date, 'yyyy-MM-dd') AS date"
_DAY_SQL = "strftime(date, '%Y-%m-%d') AS date"


def load_series(spark, folder):
    both = monthly_index(spark, folder).unionByName(second_series(spark, folder))
    return both.orderBy("series_id", "date").selectExpr("series_id", _DAY, "value")


# a short table written in code, set against the yearly responses
_OUTSIDE = [(1995, 123500), (1996, 133500), (1997, 138000), (1998, 135000), (1999, 140000), (2000, 150000), (2001, 156000)]


def inline_series(spark, folder):
    outside = literal_series(spark, "outside", _OUTSIDE).selectExpr("CAST(year(date) AS BIGINT) AS year", "value")
    pay = responses(spark, folder).groupBy("year").agg(F.expr("count(*) AS n"), F.expr("max(salary) AS highest"))
    return outside.join(pay, "year", "left").orderBy("year").selectExpr("year", "value", "n", "highest")


def interpolate_gaps(spark, folder):
    return ts.interpolate_gaps(monthly_index(spark, folder)).selectExpr("series_id", _DAY, "round(value, 6) AS value")


def interpolate_long(spark, folder):
    """Events of each type as a series by number, with every fifth value missing, cut into segments."""
    events = table(spark, folder, "events").selectExpr(
        "event_type AS series_id", "event_id AS at", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value"
    )
    return ts.interpolate_long(events, "at").selectExpr("series_id", "at", "round(value, 6) AS value")


def latest_value(spark, folder):
    both = monthly_index(spark, folder).unionByName(second_series(spark, folder))
    return ts.latest_value(both).selectExpr("series_id", _DAY, "value")


def since_filter(spark, folder):
    return ts.since(monthly_index(spark, folder), "1998-01-01").selectExpr("series_id", _DAY, "value")


def resample_year_last(spark, folder):
    both = monthly_index(spark, folder).unionByName(second_series(spark, folder))
    return ts.resample_year_last(both).selectExpr(
        "series_id", "CAST(year AS BIGINT) AS year", "value", "date_format(observed, 'yyyy-MM-dd') AS observed"
    )


def growth_vs_base(spark, folder):
    yearly = ts.resample_year_last(ts.since(monthly_index(spark, folder), "1996-01-01"))
    return ts.growth_vs_base(yearly).selectExpr(
        "series_id", "CAST(year AS BIGINT) AS year", "value", "round(growth_pct, 6) AS growth_pct"
    )


def compare_growth(spark, folder):
    table = growth_table(
        responses(spark, folder), [monthly_index(spark, folder), second_series(spark, folder)], 1996, "salary", "year"
    )
    return table.selectExpr(
        "series_id", "CAST(year AS BIGINT) AS year", "round(value, 4) AS value", "round(growth_pct, 6) AS growth_pct"
    )


_EXTRA = [("2001-05-01", 1.0), ("2001-06-01", 50000.5), ("2001-07-01", 50001.5)]


def append_missing_periods(spark, folder):
    extra = as_series(literal_table(spark, _EXTRA, "d string, v double"), "price", "d", "v")
    return ts.append_missing_periods(monthly_index(spark, folder, INDEX_END), extra).selectExpr("series_id", _DAY, "value")


def join_month_fallback(spark, folder):
    index = ts.interpolate_gaps(monthly_index(spark, folder, INDEX_END))
    joined = ts.join_month_fallback(responses(spark, folder), index, "month", "cpi")
    return joined.selectExpr("id", "date_format(month, 'yyyy-MM-dd') AS month", "round(cpi, 6) AS cpi")


def inflation_adjust(spark, folder):
    rows = adjusted_responses(spark, folder)
    return rows.selectExpr("id", "salary", "round(cpi, 6) AS cpi", "real_salary")


def table_from_sheet(spark, folder):
    """A sheet of monthly figures between three lines of preamble and one footer line."""
    monthly = (
        table(spark, folder, "orders")
        .groupBy(F.expr("date_format(o_orderdate, 'yyyy-MM-01') AS m"))
        .agg(F.expr("count(*) AS n"), F.expr("round(sum(o_totalprice), 2) AS s"), F.expr("max(o_orderkey) AS k"))
    )
    body = sheet_rows(monthly, ["m", "n", "s", "k"])
    around = literal_table(
        spark,
        [("Index report", None, None, None), (None, None, None, None), ("Month", "Billings", "Inquiries", "Contracts"),
         ("Source: orders", None, None, None)], "c0 string, c1 string, c2 string, c3 string",
    )
    long = table_of_sheet(
        around.unionByName(body), "c0", {"c1": "billings", "c2": "inquiries", "c3": "contracts"}
    )
    return long.selectExpr("date_format(month, 'yyyy-MM-dd') AS month", "measure", "round(value, 2) AS value")


QUERIES = {
    "load_series": (
        load_series,
        f"WITH {ALL_IDX_SQL}, {IDX2_SQL} SELECT series_id, {_DAY_SQL}, value FROM (SELECT * FROM idx UNION ALL SELECT * FROM idx2)",
    ),
    "inline_series": (
        inline_series,
        f"""WITH {R_SQL}, o(year, value) AS (VALUES {', '.join(f'({y}::BIGINT, {v}::DOUBLE)' for y, v in _OUTSIDE)})
        SELECT o.year, o.value, n, highest FROM o LEFT JOIN
        (SELECT year, count(*) AS n, max(salary) AS highest FROM r GROUP BY 1) y ON o.year = y.year""",
    ),
    "interpolate_gaps": (
        interpolate_gaps,
        f"WITH {ALL_IDX_SQL}, {FILLED_SQL} SELECT series_id, {_DAY_SQL}, round(value, 6) AS value FROM filled",
    ),
    "interpolate_long": (
        interpolate_long,
        f"""WITH idx AS (SELECT event_type AS series_id, event_id AS date, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events),
        {FILLED_SQL} SELECT series_id, date AS at, round(value, 6) AS value FROM filled""",
    ),
    "latest_value": (
        latest_value,
        f"""WITH {ALL_IDX_SQL}, {IDX2_SQL} SELECT series_id, strftime(max(date), '%Y-%m-%d') AS date, arg_max(value, date) AS value
        FROM (SELECT * FROM idx UNION ALL SELECT * FROM idx2) WHERE value IS NOT NULL GROUP BY 1""",
    ),
    "since_filter": (
        since_filter,
        f"WITH {ALL_IDX_SQL} SELECT series_id, {_DAY_SQL}, value FROM idx WHERE date >= DATE '1998-01-01'",
    ),
    "resample_year_last": (
        resample_year_last,
        f"""WITH {ALL_IDX_SQL}, {IDX2_SQL} SELECT series_id, year(date) AS year, arg_max(value, date) AS value,
        strftime(max(date), '%Y-%m-%d') AS observed
        FROM (SELECT * FROM idx UNION ALL SELECT * FROM idx2) WHERE value IS NOT NULL GROUP BY 1, 2""",
    ),
    "growth_vs_base": (
        growth_vs_base,
        f"""WITH {ALL_IDX_SQL}, y AS (SELECT series_id, year(date) AS year, arg_max(value, date) AS value FROM idx
        WHERE value IS NOT NULL AND date >= DATE '1996-01-01' GROUP BY 1, 2)
        SELECT series_id, year, value, round((value / first_value(value) OVER (PARTITION BY series_id ORDER BY year) - 1) * 100, 6) AS growth_pct FROM y""",
    ),
    "compare_growth": (
        compare_growth,
        f"""WITH {R_SQL}, {ALL_IDX_SQL}, {IDX2_SQL}, y AS (
        SELECT series_id, year(date) AS year, arg_max(value, date) AS value FROM (SELECT * FROM idx UNION ALL SELECT * FROM idx2)
        WHERE value IS NOT NULL AND date >= DATE '1996-01-01' GROUP BY 1, 2
        UNION ALL SELECT 'median_pay', year, median(salary) FROM r WHERE year >= 1996 GROUP BY 2)
        SELECT series_id, year, round(value, 4) AS value,
        round((value / first_value(value) OVER (PARTITION BY series_id ORDER BY year) - 1) * 100, 6) AS growth_pct FROM y""",
    ),
    "append_missing_periods": (
        append_missing_periods,
        f"""WITH {IDX_SQL}, e(date, value) AS (VALUES {', '.join(f"(DATE '{d}', {v}::DOUBLE)" for d, v in _EXTRA)})
        SELECT series_id, {_DAY_SQL}, value FROM idx UNION ALL
        SELECT 'price', {_DAY_SQL}, value FROM e WHERE date NOT IN (SELECT date FROM idx)""",
    ),
    "join_month_fallback": (
        join_month_fallback,
        f"WITH {ADJUSTED_SQL} SELECT id, strftime(month, '%Y-%m-%d') AS month, round(cpi, 6) AS cpi FROM adjusted",
    ),
    "inflation_adjust": (
        inflation_adjust,
        f"WITH {ADJUSTED_SQL} SELECT id, salary, round(cpi, 6) AS cpi, real_salary FROM adjusted",
    ),
    "table_from_sheet": (
        table_from_sheet,
        """WITH m AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, CAST(count(*) AS DOUBLE) AS billings,
        round(sum(o_totalprice), 2) AS inquiries, CAST(max(o_orderkey) AS DOUBLE) AS contracts FROM orders GROUP BY 1)
        UNPIVOT m ON billings, inquiries, contracts INTO NAME measure VALUE value""",
    ),
}
