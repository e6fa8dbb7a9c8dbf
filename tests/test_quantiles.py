"""Exact quantiles, box plots, histograms and densities against numpy."""

import math

import numpy as np
import pytest

from paylens.operators import distributions as d
from paylens.operators import quantiles
from paylens.operators.quantiles import SHIFTS, group_median, group_quantiles, key_of, quantiles_of_counts, value_counts
from tests.conftest import rows

RNG = np.random.default_rng(7)
SAMPLES = {
    "one": [5.0],
    "two": [1.0, 2.0],
    "equal": [3.0] * 50,
    "negative": list(RNG.normal(0, 1000, 301)),
    "tiny": list(RNG.normal(0, 1e-7, 100)),
    "outlier": [*RNG.uniform(40000, 60000, 400).round(2), 1e12, -1e12],
    "dense": list(RNG.integers(50000, 50020, 1000).astype(float)),
    "zeros": [0.0, -0.0, 0.0, 1.0],
}


@pytest.fixture(scope="module")
def samples(spark):
    data = [(k, float(v)) for k, vs in SAMPLES.items() for v in vs]
    return spark.createDataFrame([*data, ("one", None), ("one", math.nan), (None, 1.0)], "k string, v double")


def test_quantiles_match_numpy(samples):
    probs = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "m": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in group_quantiles(samples, ["k"], "v", probs).collect()}
    assert set(got) == set(SAMPLES)
    for k, vs in SAMPLES.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, name)


def test_median_without_groups(samples):
    every = [v for vs in SAMPLES.values() for v in vs] + [1.0]
    assert group_median(samples, [], "v").collect()[0][0] == pytest.approx(np.median(every))


def test_median_of_one_hot_group(spark):
    df = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN CAST(id % 7 AS STRING) ELSE 'hot' END AS k", "(id * 7919 % 30011) / 100 AS v"
    )
    pdf = df.toPandas()
    wanted = pdf.groupby("k").v.median()
    got = group_median(df, ["k"], "v").toPandas().set_index("k")["median"]
    assert np.allclose(got.sort_index(), wanted.sort_index(), rtol=1e-12)


def test_approximate_returns_an_element(spark):
    df = spark.range(10).selectExpr("1 AS k", "CAST(id AS DOUBLE) AS v")
    assert group_median(df, ["k"], "v").collect()[0][1] == 4.5
    assert group_median(df, ["k"], "v", approximate=True).collect()[0][1] == 4.0


EXTREMES = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999]
EXTREMES += [1.7976931348623157e308, math.inf, 3.0, 2.0**52 + 1, 2.0**-60, 1e-12, 1e-4, 123456.78, 2.0**-1000, 1.5 * 2.0**-1040]


def test_keys_are_the_bits_of_the_value(spark):
    values = [*EXTREMES, *(-v for v in EXTREMES), *RNG.normal(0, 1, 500), *10.0 ** RNG.uniform(-300, 300, 500), *(2.0 ** np.arange(-1074, 1024, 7.0))]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").selectExpr("v", f"{key_of('v')} AS k")
    for v, k in df.collect():
        bits = int(np.float64(abs(v)).view(np.int64))
        assert k == (-bits if v < 0 else bits), v
    assert spark.sql(f"SELECT {key_of('v')} FROM VALUES (double('NaN')) t(v)").first()[0] is None


def test_log_uniform_values_are_spread_over_cells(spark):
    """A million values between 1e-12 and 1e-4: no cell has 10,000 of them, and the median is exact."""
    df = spark.range(1_000_000).selectExpr("1 AS g", "pow(10D, -12 + 8 * (id * 7919 % 1000003) / 1000003D) AS v")
    crowded = df.selectExpr(f"shiftright({key_of('v')}, {SHIFTS[0]}) AS c").groupBy("c").count().selectExpr("max(count)").first()[0]
    assert crowded < 10_000
    values = np.sort([r[0] for r in df.select("v").collect()])
    assert group_median(df, ["g"], "v").first()[1] == pytest.approx(float(np.median(values)), rel=1e-12)


@pytest.mark.parametrize("shifts", [(40, 20), (50, 40), (60, 45, 30, 0)])
def test_crowded_cells_are_cut_again(spark, samples, monkeypatch, shifts):
    """Cells so wide, and the limit so low, that every level is used."""
    monkeypatch.setattr(quantiles, "SHIFTS", shifts)
    monkeypatch.setattr(quantiles, "SMALL", 4)
    monkeypatch.setattr(d, "SHIFTS", shifts)
    counts = value_counts(samples, ["k"], "v")
    probs = {"q1": 0.25, "m": 0.5, "p90": 0.9}
    got = {r["k"]: r for r in quantiles_of_counts(counts, ["k"], probs, deep=True).collect()}
    for k, vs in SAMPLES.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (k, name)
    box = {r["k"]: r["whisker_high"] for r in d.boxplot_stats(samples, ["k"], "v", deep=True).collect()}
    flat = {r["k"]: r["whisker_high"] for r in d.boxplot_stats(samples, ["k"], "v", deep=False).collect()}
    assert box == pytest.approx(flat, rel=1e-12)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert rows(group_median(empty, ["k"], "v")) == []
    assert rows(group_median(empty, [], "v")) == [(None,)]


def test_boxplot(samples):
    got = {r["k"]: r for r in d.boxplot_stats(samples, ["k"], "v").collect()}
    for k, vs in SAMPLES.items():
        q1, m, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        inside = [v for v in vs if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        wanted = (len(vs), q1, m, q3, min(q1, min(inside)), max(q3, max(inside)))
        assert got[k][1:] == pytest.approx(wanted, rel=1e-12, abs=1e-12), k


@pytest.mark.parametrize("bins", [1, 9, 30, 100])
def test_histogram_matches_numpy(spark, bins):
    values = np.concatenate([RNG.integers(1, 11, 500).astype(float), np.linspace(1, 10, 91)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = d.histogram_equal_width(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n"] for r in got] == list(counts)
    assert [r["left"] for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_with_cut_and_single_value(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (400.0,)], "v double")
    got = d.histogram_equal_width(df, "v", 2, below=100).orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(0, 3.5, 4.0, 0), (1, 4.0, 4.5, 2)]


@pytest.mark.parametrize("n", [30, 5000])
def test_density_matches_formula(spark, n):
    values = RNG.lognormal(11, 0.5, n).round(-2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = d.density_curve(df, "v", bins=50, points=200).orderBy("point").collect()
    h = values.std(ddof=1) * n ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    kernel = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / h) ** 2).sum(axis=1)
    wanted = kernel / (h * math.sqrt(2 * math.pi)) * (values.max() - values.min()) / 50
    assert [r["x"] for r in got] == pytest.approx(list(grid))
    assert [r["density"] for r in got] == pytest.approx(list(wanted), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("low, high", [(0.0, 0.0001), (100000.0, 100010.0)])
def test_crowded_values_are_cut_again(spark, low, high):
    """A thousand times ten thousand values in a few cells of the first grid."""
    df = spark.range(200_000).selectExpr("id % 2 AS g", f"{low}D + ({high}D - {low}D) * (id * 7919 % 200000) / 200000 AS v")
    got = {r["g"]: r["median"] for r in group_median(df, ["g"], "v").collect()}
    for g in (0, 1):
        values = sorted(low + (high - low) * (i * 7919 % 200000) / 200000 for i in range(g, 200_000, 2))
        assert got[g] == pytest.approx((values[49_999] + values[50_000]) / 2, rel=1e-12)


@pytest.mark.parametrize("n", [1, 20])
def test_density_of_values_without_spread_is_null(spark, n):
    got = d.density_curve(spark.range(n).selectExpr("5D AS v"), "v", bins=10, points=6).collect()
    assert [(r["x"], r["density"]) for r in got] == [(5.0, None)] * 6
