"""Economic series as one long table (series_id, date, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from paylens.functions.sql import lit
from paylens.sources.literals import literal_table


def read_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A two-column file `DATE,value` with a header; a blank value is null."""
    raw = spark.read.schema("date date, value double").option("header", True).option("mode", "FAILFAST").csv(path)
    return as_series(raw, series_id, "date", "value")


def as_series(df: DataFrame, series_id: str, date: str, value: str) -> DataFrame:
    """Any dated table as a long series; `date` and `value` are SQL expressions."""
    return df.selectExpr(
        f"{lit(series_id)} AS series_id", f"CAST({date} AS DATE) AS date", f"CAST({value} AS DOUBLE) AS value"
    )


def inline_series(spark: SparkSession, series_id: str, rows: Sequence[tuple[int, float]]) -> DataFrame:
    """A handful of (year, value) pairs written in code, dated 1 January."""
    years = literal_table(spark, [(int(y), float(v)) for y, v in rows], "year int, value double")
    return as_series(years, series_id, "make_date(year, 1, 1)", "value")
