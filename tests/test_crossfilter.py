"""Shared cross-filter state, moving filters and the index of values."""

import random

import pytest

from paylens.operators import crossfilter as x
from paylens.operators import facets as f
from paylens.operators.suggestions import build_index, open_index, suggest
from tests.conftest import rows

FILTERS = f.FilterSet({"a": "a IN ('p', 'q')", "b": "b > 2", "m": "m BETWEEN 10 AND 60"})


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    data = [(i, draw.choice(["p", "q", "r", None]), draw.choice([1, 2, 3, 4, None]), draw.choice(["x", "y"]), draw.choice([None, draw.uniform(-5, 105)])) for i in range(600)]
    return spark.createDataFrame(data, "id long, a string, b int, c string, m double")


def brute(data, conditions, facets):
    out = {}
    for r in data:
        for facet, key in facets(r).items():
            if key != "outside":
                hit = all(c(r) for a, c in conditions.items() if a != facet)
                out[facet, key] = out.get((facet, key), 0) + hit
    return out


def keys_of(r):
    m = r["m"]
    return {"a": r["a"], "c": r["c"], "b": None if r["b"] is None else str(r["b"]), "m": "outside" if m is None or not 0 <= m <= 100 else str(min(int(m // 10), 9))}


CONDITIONS = {
    "a": lambda r: r["a"] in ("p", "q"),
    "b": lambda r: r["b"] is not None and r["b"] > 2,
    "m": lambda r: r["m"] is not None and 10 <= r["m"] <= 60,
}
BINS = {"m": x.Bins(0, 100, 10)}


def test_one_pass_gives_every_facet_and_histogram(table):
    got = {(r["facet"], r["key"]): r["count"] for r in x.cross_counts(table, FILTERS, ["a", "b", "c"], BINS).collect()}
    assert got == {**{("m", str(i)): 0 for i in range(10)}, **brute(table.collect(), CONDITIONS, keys_of)}
    shared = {k: v for k, v in got.items() if k[0] != "m"}
    assert shared == {(r["facet"], r["key"]): r["count"] for r in f.facet_counts(table, FILTERS, ["a", "b", "c"]).collect()}
    assert [got["m", str(r["bin"])] for r in f.facet_histogram(table, FILTERS, "m", 0, 100, 10).orderBy("bin").collect()] == [got["m", str(i)] for i in range(10)]


def test_each_condition_is_evaluated_once(table):
    marked = f.FilterSet({"a": "contains(a, 'only-here')", "b": "b > 2", "m": "m < 60"})
    plan = x.cross_counts(table, marked, ["a", "b", "c"], BINS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("only-here") == 1
    several = f.facet_counts(table, marked, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert several.count("only-here") > 1


@pytest.mark.parametrize("condition, moved", [("at IN ('r')", lambda r: r["a"] == "r"), ("at IS NULL", lambda r: r["a"] is None), ("FALSE", lambda r: False), ("TRUE", lambda r: True)])
def test_a_moved_filter_needs_no_rows(table, condition, moved):
    cube = x.moving_filter_cube(table, FILTERS, "a", ["a", "b", "c"], BINS)
    got = {(r["facet"], r["key"]): r["count"] for r in x.move_filter(cube, "a", condition).collect()}
    assert got == {**{("m", str(i)): 0 for i in range(10)}, **brute(table.collect(), {**CONDITIONS, "a": moved}, keys_of)}
    assert cube.count() < 120 and "LogicalRDD" not in cube._jdf.queryExecution().optimizedPlan().toString()


def test_a_moved_range(table):
    cube = x.moving_filter_cube(table, FILTERS, "m", ["a", "b"], step=x.Bins(0, 100, 20))
    got = {(r["facet"], r["key"]): r["count"] for r in x.move_filter(cube, "m", "at BETWEEN 4 AND 11").collect()}
    inside = lambda r: r["m"] is not None and 20 <= r["m"] < 60
    assert got == brute(table.collect(), {**CONDITIONS, "m": inside}, lambda r: {k: v for k, v in keys_of(r).items() if k in "ab"})


def test_no_filters_and_no_rows(spark, table):
    none = f.FilterSet()
    assert rows(x.cross_counts(table, none, ["c"]), "count") == sorted((n,) for n in [r["count"] for r in table.groupBy("c").count().collect()])
    empty = table.where("FALSE")
    assert rows(x.cross_counts(empty, FILTERS, ["a"])) == []
    assert [r["count"] for r in x.cross_counts(empty, FILTERS, ["a"], BINS).collect()] == [0] * 10


VALUES = ["Austin, TX, US", "austin", "Boston", "Ünïversity of Hawaiʻi", "N/A", "", "a", "ab", "It's", None, "tt", "100%_x", "TIN TIN"]


@pytest.fixture(scope="module")
def places(spark):
    draw = random.Random(1)
    return spark.createDataFrame([(i, draw.choice(VALUES)) for i in range(400)], "id long, place string")


def test_the_index_suggests_what_a_scan_does(spark, places, tmp_path):
    path = str(tmp_path / "index")
    build_index(places, "place", "id", path)
    index = open_index(spark, path)
    for query in ("", "a", "T", "tin", "TIN ", "austin", "Austin, TX, US!", "hawaiʻi", "ünï", "'", "%_", "zzz", "tinx", "us", " "):
        for limit in (None, 3):
            want = [tuple(r) for r in f.suggest_values(places, "place", query, "id", limit).collect()]
            found = suggest(index, "place", query, limit)
            assert [tuple(r) for r in found.collect()] == want, query
            assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    plan = suggest(index, "place", "austin")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), IsNotNull(key), EqualTo(gram," in plan


def test_index_of_nothing(places):
    index = build_index(places.where("FALSE"), "place", "id")
    assert suggest(index, "place", "abcd").collect() == [] == suggest(index, "place", "").collect()
