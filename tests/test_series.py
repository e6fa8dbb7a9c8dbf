"""Series: gaps, latest values, growth, inflation adjustment. Golden values from public index data."""

import datetime as dt

import pytest

from paylens.operators import timeseries as ts
from paylens.plans.growth import growth_table
from paylens.sources.series import as_series, inline_series, read_series
from tests.conftest import rows


def monthly(spark, values, start=(2025, 8)):
    data = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i
        data.append((dt.date(start[0] + m // 12, m % 12 + 1, 1), v))
    return as_series(spark.createDataFrame(data, "d date, v double"), "s", "d", "v")


def values(df):
    return [r["value"] for r in df.orderBy("series_id", "date").collect()]


def test_gaps(spark):
    assert values(ts.interpolate_gaps(monthly(spark, [None, 1.0, None, None, 4.0, None]))) == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values(ts.interpolate_gaps(monthly(spark, [None, None]))) == [None, None]


def test_gaps_go_by_position_and_stay_within_a_series(spark):
    first = monthly(spark, [1.0, None, 2.0])
    second = as_series(
        spark.createDataFrame([("2020-01-01", 10.0), ("2020-02-01", None), ("2024-01-01", 20.0)], "d string, v double"), "t", "d", "v"
    )
    assert values(ts.interpolate_gaps(first.unionByName(second))) == [1.0, 1.5, 2.0, 10.0, 15.0, 20.0]


CPI = "DATE,CPIAUCSL\n2025-11-01,325.063\n2015-01-01,234.747\n2024-12-01,317.604\n2025-09-01,324.245\n2025-10-01,\n2026-04-01,332.407\n"


@pytest.fixture
def cpi(spark, tmp_path):
    (tmp_path / "cpi.csv").write_text(CPI)
    return ts.interpolate_gaps(read_series(spark, str(tmp_path / "cpi.csv"), "cpi"))


def test_read_series_and_golden_gap(cpi):
    got = {str(r["date"]): r["value"] for r in cpi.collect()}
    assert got["2025-10-01"] == pytest.approx(324.654)
    assert len(got) == 6


def test_latest(cpi):
    assert rows(ts.latest_value(cpi), "date", "value") == [(dt.date(2026, 4, 1), 332.407)]


def test_inflation_golden_values(spark, cpi):
    data = [
        (1, 60000, "2024-12-01"), (2, 60000, "2025-10-01"), (3, 60000, "2026-06-01"),
        (4, 75600, "2015-01-01"), (5, 60000, "2010-01-01"), (6, 60000, None),
    ]
    facts = spark.createDataFrame(data, "id int, pay bigint, m string").selectExpr("id", "pay", "CAST(m AS DATE) AS m")
    joined = ts.join_month_fallback(facts, cpi, "m", "cpi")
    out = ts.inflation_adjust(joined, "pay", "cpi", ts.current_value(cpi), "real")
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["real"] for i in range(1, 7)] == [62800.0, 61400.0, 60000.0, 107100.0, None, None]
    # only months after the last observation take the latest value
    assert got[3]["cpi"] == 332.407 and got[5]["cpi"] is None
    assert out.columns == ["m", "id", "pay", "cpi", "real"] or set(out.columns) == {"m", "id", "pay", "cpi", "real"}


def test_half_even_hundreds(spark, cpi):
    facts = spark.createDataFrame([(12250.0, 1.0), (12350.0, 1.0)], "pay double, cpi double")
    one = spark.range(1).selectExpr("1.0D AS v").scalar()
    assert rows(ts.inflation_adjust(facts, "pay", "cpi", one, "real"), "real") == [(12200.0,), (12400.0,)]


def test_year_last_and_growth(spark):
    data = [
        ("2015-06-01", 1.0), ("2015-12-01", 237.761), ("2016-12-01", 242.637), ("2016-11-01", 240.0),
        ("2020-12-01", 262.045), ("2021-01-01", None), ("2014-12-01", 9.0),
    ]
    s = as_series(spark.createDataFrame(data, "d string, v double"), "cpi", "d", "v")
    yearly = ts.growth_vs_base(ts.resample_year_last(ts.since(s, "2015-01-01")))
    got = {r["year"]: (r["value"], r["growth_pct"]) for r in yearly.collect()}
    assert got[2015] == (237.761, 0.0)
    assert got[2016][1] == pytest.approx(2.0508, abs=1e-4)
    assert got[2020][1] == pytest.approx(10.2136, abs=1e-4)
    assert got[2021] == (None, None)
    assert 2014 not in got


def test_inline_growth(spark):
    outside = inline_series(spark, "outside", [(2024, 179000), (2015, 123500), (2016, 133500)])
    got = {r["year"]: r["growth_pct"] for r in ts.growth_vs_base(ts.resample_year_last(outside)).collect()}
    assert got[2016] == pytest.approx(8.0972, abs=1e-4)
    assert got[2024] == pytest.approx(44.9393, abs=1e-4)


def test_real_rows_win_over_added_ones(spark):
    s = monthly(spark, [1.0, 2.0])
    extra = as_series(spark.createDataFrame([("2025-09-01", 99.0), ("2025-10-01", 3.0)], "d string, v double"), "s", "d", "v")
    assert values(ts.append_missing_periods(s, extra)) == [1.0, 2.0, 3.0]


def test_growth_table(spark):
    pay = spark.createDataFrame([(2014, 1.0), (2015, 100.0), (2015, 200.0), (2016, 300.0)], "Year int, Salary double")
    s = as_series(spark.createDataFrame([("2015-03-01", 10.0), ("2016-03-01", 11.0)], "d string, v double"), "cpi", "d", "v")
    got = {(r["series_id"], r["year"]): r["growth_pct"] for r in growth_table(pay, [s], 2015).collect()}
    assert got == {("median_pay", 2015): 0.0, ("median_pay", 2016): 100.0, ("cpi", 2015): 0.0, ("cpi", 2016): pytest.approx(10.0)}
