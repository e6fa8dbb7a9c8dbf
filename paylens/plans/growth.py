"""Growth of survey pay next to economic series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paylens.functions.sql import q
from paylens.operators.quantiles import group_median
from paylens.operators.timeseries import compare_growth, resample_year_last, since


def pay_series(responses: DataFrame, measure: str = "Salary", year: str = "Year") -> DataFrame:
    """Yearly median pay as a series (series_id, year, value)."""
    return group_median(responses, [year], measure, "value").selectExpr(
        "'median_pay' AS series_id", f"{q(year)} AS year", "value"
    )


def growth_table(
    responses: DataFrame,
    series: Sequence[DataFrame],
    first_year: int,
    measure: str = "Salary",
    year: str = "Year",
) -> DataFrame:
    """Percent growth since the first year kept: survey median and each series, long form."""
    pay = pay_series(responses.where(f"{q(year)} >= {first_year}"), measure, year)
    yearly = [resample_year_last(since(s, f"{first_year}-01-01")) for s in series]
    return compare_growth([pay, *yearly])
