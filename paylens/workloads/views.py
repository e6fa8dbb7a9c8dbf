"""Survey-like views of the benchmark tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators import timeseries as ts
from paylens.sources.series import as_series

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
STATUSES = ["F", "O", "P"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Column name -> expression that both engines read. Nulls and units are set by rule, as the
# tables have none; every order is one response.
RESPONSE_COLUMNS = {
    "id": "o_orderkey",
    "salary": "o_totalprice",
    "satisfaction": "1 + o_orderkey % 10",
    "month": "CAST(date_trunc('month', o_orderdate) AS DATE)",
    "year": "CAST(year(o_orderdate) AS BIGINT)",
    "firm_type": "c_mktsegment",
    "experience": "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END",
    "gender": "o_orderstatus",
    "location": "n_name",
    "work_status": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 10 = 3 THEN 'Part-time' ELSE 'Full-time' END",
    "unit": "CASE o_orderkey % 10 WHEN 0 THEN 'hour' WHEN 1 THEN 'CADyear' WHEN 2 THEN 'CHFyear' ELSE 'year' END",
}
_PLACE = {
    0: ("-170 + (c_custkey * 7919 % 4000) / 100", "55 + (c_custkey * 104729 % 1600) / 100"),
    1: ("-160 + (c_custkey * 7919 % 500) / 100", "19 + (c_custkey * 104729 % 350) / 100"),
    2: ("-67 + (c_custkey * 7919 % 200) / 100", "18 + (c_custkey * 104729 % 100) / 100"),
    3: ("144 + (c_custkey * 7919 % 100) / 100", "13 + (c_custkey * 104729 % 100) / 100"),
}
_MAINLAND = ("-124 + (c_custkey * 7919 % 5700) / 100", "25 + (c_custkey * 104729 % 2400) / 100")


def _place(which: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {pair[which]}" for k, pair in _PLACE.items())
    return f"CASE c_custkey % 25 {cases} ELSE {_MAINLAND[which]} END"


LON, LAT = _place(0), _place(1)
COORDINATE_COLUMNS = {"lon": LON, "lat": LAT}


def responses(spark: SparkSession, folder: str, places: bool = False) -> DataFrame:
    """Orders with customer and nation, as survey responses."""
    columns = {**RESPONSE_COLUMNS, **(COORDINATE_COLUMNS if places else {})}
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    joined = orders.join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


_ALL = {**RESPONSE_COLUMNS, **COORDINATE_COLUMNS}
R_SQL = (
    "r AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _ALL.items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)

# A monthly index from shipped goods. Every seventh month has no value, the first one included;
# the last months are missing, so late orders need the fallback.
INDEX_END = "2001-06-01"


# mean price in thousandths by whole-number arithmetic, so that no rounding tie depends on the engine
_MEAN = "sum(CAST(round(p * 100, 0) AS BIGINT)) * 10"


def _gap(month: str) -> str:
    return f"((year({month}) - 1995) * 12 + month({month}) - 1) % 7 = 0"


def monthly_index(spark: SparkSession, folder: str, end: str | None = None) -> DataFrame:
    """The index of all months, or of those before `end`."""
    months = table(spark, folder, "lineitem").selectExpr(
        "CAST(date_trunc('month', l_shipdate) AS DATE) AS m", "l_extendedprice AS p"
    )
    monthly = (
        (months.where(f"m < DATE'{end}'") if end else months)
        .groupBy("m")
        .agg(F.expr(f"{_MEAN} DIV count(*) / 1000D AS v"))
    )
    return as_series(monthly, "price", "m", f"CASE WHEN {_gap('m')} THEN NULL ELSE v END")


def second_series(spark: SparkSession, folder: str) -> DataFrame:
    monthly = (
        table(spark, folder, "orders")
        .selectExpr("CAST(date_trunc('month', o_orderdate) AS DATE) AS m", "o_totalprice AS p")
        .groupBy("m")
        .agg(F.expr(f"{_MEAN} DIV count(*) / 1000D AS v"))
    )
    return as_series(monthly, "orders", "m", f"CASE WHEN {_gap('m')} THEN NULL ELSE v END")


def _series_sql(series_id: str, source: str, stamp: str, price: str, cut: str) -> str:
    return (
        f"SELECT '{series_id}' AS series_id, m AS date, CASE WHEN {_gap('m')} THEN NULL ELSE v END AS value FROM "
        f"(SELECT CAST(date_trunc('month', {stamp}) AS DATE) AS m, CAST({_MEAN.replace('p *', price + ' *')} // count(*) AS DOUBLE) / 1000 AS v FROM {source} GROUP BY 1) {cut}"
    )


ALL_IDX_SQL = f"idx AS ({_series_sql('price', 'lineitem', 'l_shipdate', 'l_extendedprice', '')})"
IDX_SQL = f"idx AS ({_series_sql('price', 'lineitem', 'l_shipdate', 'l_extendedprice', f'''WHERE m < DATE '{INDEX_END}' ''')})"
IDX2_SQL = f"idx2 AS ({_series_sql('orders', 'orders', 'o_orderdate', 'o_totalprice', '')})"

# The index without gaps: position within the series, known values around each gap.
FILLED_SQL = """
pos AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS p FROM idx),
around AS (SELECT *,
    last_value(value IGNORE NULLS) OVER b AS v0,
    last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
    first_value(value IGNORE NULLS) OVER a AS v1,
    first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1
  FROM pos WINDOW b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT series_id, date, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL
    WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (p1 - p0) * (p - p0) END AS value FROM around),
latest AS (SELECT arg_max(value, date) AS value, max(date) AS date FROM filled WHERE value IS NOT NULL)""".strip()
_ADJUST_SQL = """
adjusted AS (SELECT r.*, coalesce(f.value, CASE WHEN r.month > latest.date THEN latest.value END) AS cpi,
    round_even(r.salary * (latest.value / coalesce(f.value, CASE WHEN r.month > latest.date THEN latest.value END)), -2) AS real_salary
  FROM r LEFT JOIN filled f ON r.month = f.date CROSS JOIN latest)"""
ADJUSTED_SQL = f"{R_SQL}, {IDX_SQL}, {FILLED_SQL}, {_ADJUST_SQL.strip()}"


def adjusted_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with the index of their month and the pay in today's money."""
    index = ts.interpolate_gaps(monthly_index(spark, folder, INDEX_END))
    joined = ts.join_month_fallback(responses(spark, folder), index, "month", "cpi")
    return ts.inflation_adjust(joined, "salary", "cpi", ts.current_value(index), "real_salary")
