"""Filters, facet counts, search, profiles and pivots."""

import itertools
import random

import pytest

from paylens.operators import aggregates as a
from paylens.operators import facets as f
from tests.conftest import rows

R = random.Random(2)
DATA = [
    (i, R.choice(["Male", "Female", None]), R.choice(["A", "B", "C"]), R.choice([1, 2, 10]), float(R.randrange(0, 1000)))
    for i in range(500)
]


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(DATA, "id int, gender string, firm string, score int, pay double")
    return f.fill_not_given(df, ["gender"])


FILTERS = f.FilterSet(
    {"gender": f.membership("gender", ["Male", "N/A"]), "firm": f.membership("firm", ["A"]), "pay": f.value_range("pay", 100.0, 900.0)}
)


def passes(row, without=None):
    _, gender, firm, _, pay = row
    tests = {"gender": (gender or "N/A") in ("Male", "N/A"), "firm": firm == "A", "pay": 100 <= pay <= 900}
    return all(v for k, v in tests.items() if k != without)


def test_flags_keep_every_row(people):
    got = {r["id"]: r["passes"] for r in f.flag_rows(people, FILTERS).collect()}
    assert got == {d[0]: passes(d) for d in DATA}


def test_facets_ignore_their_own_filter(people):
    got = {(r["facet"], r["key"]): r["count"] for r in f.facet_counts(people, FILTERS, ["gender", "firm", "score"]).collect()}
    place = {"gender": 1, "firm": 2, "score": 3}
    wanted = {}
    for facet, at in place.items():
        for d in DATA:
            key = (facet, str(d[at] or "N/A"))
            wanted[key] = wanted.get(key, 0) + passes(d, facet)
    assert got == wanted


def test_unfiltered_facets_are_plain_counts(people):
    got = {r["key"]: r["count"] for r in f.facet_counts(people, f.FilterSet(), ["firm"]).collect()}
    assert got == {r["firm"]: r["n"] for r in a.count_by_group(people, ["firm"]).collect()}


def test_keys_without_rows_stay(people):
    none = f.FilterSet({"pay": "pay < 0"})
    assert {r["count"] for r in f.facet_counts(people, none, ["firm"]).collect()} == {0}


def test_facet_histogram(people):
    got = [r["count"] for r in f.facet_histogram(people, FILTERS, "pay", 0, 500, 5).orderBy("bin").collect()]
    wanted = [0] * 5
    for d in DATA:
        if passes(d, "pay") and d[4] <= 500:
            wanted[min(int(d[4] // 100), 4)] += 1
    assert got == wanted


def test_facet_histogram_over_the_range_of_all_rows(people):
    got = [(r["left"], r["count"]) for r in f.facet_histogram(people, FILTERS, "pay", bins=4).orderBy("bin").collect()]
    lo, hi = min(d[4] for d in DATA), max(d[4] for d in DATA)
    width, wanted = (hi - lo) / 4, [0] * 4
    for d in DATA:
        if passes(d, "pay"):
            wanted[min(int((d[4] - lo) / width), 3)] += 1
    assert [n for _, n in got] == wanted
    assert [x for x, _ in got] == pytest.approx([lo + i * width for i in range(4)])


def test_range_opens_near_the_cap(people):
    assert f.value_range("pay", 1.0, 999.5, cap=1000.0) == "`pay` >= 1.0D"
    assert "BETWEEN" in f.value_range("pay", 1.0, 999.0, cap=1000.0)
    assert "BETWEEN" in f.value_range("pay", 1.0, 5000.0)


def test_text_search(spark):
    df = spark.createDataFrame([("Cornell",), ("",), (None,), ("100% any'\\",)], "s string")

    def found(query):
        return [r[0] for r in rows(df.where(f.text_search("s", query)))]

    assert len(found("")) == 4
    assert found("any") == ["100% any'\\", "Cornell"]
    assert found("none") == ["", None]
    assert found("cORN") == ["Cornell"]
    assert found("0% a") == ["100% any'\\"]
    assert found("'\\") == ["100% any'\\"]


def test_toggle_and_moved_filter():
    assert f.toggle(["a"], "b") == ["a", "b"]
    assert f.toggle(["a", "b"], "a") == ["b"]
    moved = FILTERS.moved("pay", "real", "real > 1")
    assert set(moved.conditions) == {"gender", "firm", "real"}
    assert f.named_filter({"low": "pay < 1"}, "low") == "pay < 1"


def test_unknown_conditions_fail(spark):
    df = spark.createDataFrame([(None,), (5,)], "x int")
    out = f.flag_rows(df, f.FilterSet({"x": "x > 1"}))
    assert rows(out) == [(5, True), (None, False)]


def test_bar_orders(spark):
    df = spark.createDataFrame([("firm", "10", 3), ("firm", "9", 7), ("firm", "N/A", 5)], "facet string, key string, count bigint")

    def keys(**how):
        return [r["key"] for r in f.facet_order(df, **how).collect()]

    assert keys() == ["9", "10", "N/A"]
    assert keys(ascending=False) == ["10", "9", "N/A"]
    assert keys(by="count") == ["10", "N/A", "9"]
    assert keys(by="count", ascending=False) == ["9", "N/A", "10"]
    assert keys(order=["N/A", "10"]) == ["N/A", "10", "9"]


def test_suggestions(spark):
    data = [(1, "Yale"), (2, "MIT"), (3, "MIT"), (4, "Yale"), (5, "N/A"), (6, None), (7, "Smith"), (8, "N/A")]
    df = spark.createDataFrame(data, "id int, school string")
    assert [r["school"] for r in f.suggest_values(df, "school", "", "id").collect()] == ["Yale", "MIT", "Smith"]
    assert [r["school"] for r in f.suggest_values(df, "school", "MI", "id").collect()] == ["MIT", "Smith"]
    assert [r["school"] for r in f.suggest_values(df, "school", "", "id", limit=1).collect()] == ["Yale"]


def test_topn_ties_are_first_seen(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "c"), (5, "a"), (6, None), (7, None), (8, None)], "id int, k string")
    assert [r["k"] for r in a.topn_values(df, "k", 2, "id").collect()] == ["c", "b"]


def test_profiles(spark):
    data = [(i, k, e, float(p), s, ag) for i, (k, e, p, s, ag) in enumerate(
        [("X", "1", 10, 5, "26-30"), ("Y", "< 1", 30, 6, "21-25"), ("X", "> 40", 20, 7, "26-30"), ("Z", "odd", 5, 1, "21-25"), ("Y", None, 50, 9, None)]
    )]
    df = spark.createDataFrame(data, ["id", "Location", "Years of Experience", "Salary", "Job Satisfaction", "Age"])

    def profile(column, feature, **more):
        return [tuple(r) for r in a.profile_by_attribute(df, column, feature, "id", **more).collect()]

    assert profile("Years of Experience", "count") == [("< 1", 1), ("1", 1), ("> 40", 1), ("odd", 1)]
    assert profile("Age", "mean") == [("21-25", 3.5), ("26-30", 6.0)]
    assert profile("Location", "median", n=2) == [("X", 15.0), ("Y", 40.0)]
    assert profile("Location", "count") == [("Z", 1), ("X", 2), ("Y", 2)]
    with pytest.raises(ValueError):
        profile("Age", "mode")


def test_matrices(spark):
    df = spark.createDataFrame(
        [("A", "1", 5, 10.0), ("A", "1", 7, 30.0), ("B", "2", 4, 8.0), ("B", None, 4, 8.0), (None, "1", 1, 1.0)], "firm string, years string, sat int, pay double"
    )
    got = {r["firm"]: r.asDict() for r in a.pivot_matrices(df, "firm", "years", ["1", "2", "3"], "sat", "pay").collect()}
    assert got["A"] == {"firm": "A", "mean_1": 6.0, "mean_2": None, "mean_3": None, "median_1": 20.0, "median_2": None,
                        "median_3": None, "count_1": 2, "count_2": 0, "count_3": 0}
    assert got["B"]["count_2"] == 1 and set(got) == {"A", "B"}


def test_bands_and_wide(spark):
    df = spark.createDataFrame([(a_, g, float(i), n) for i, (a_, g, n) in enumerate(itertools.product(["x", "y"], ["M", "F"], [2]))], "age string, gender string, mean double, n bigint")
    df = df.union(spark.createDataFrame([("z", "M", 9.0, 4)], df.schema))
    got = {(r["age"], r["gender"]): (r["thickness"], r["low"], r["high"]) for r in a.count_band(df, "gender").collect()}
    assert got[("x", "M")] == (2.5, -1.25, 1.25) and got[("z", "M")] == (5.0, 6.5, 11.5)
    wide = {r["age"]: r.asDict() for r in a.pivot_long_wide(df, "age", "gender", ["M", "F"], "mean").collect()}
    assert wide["z"] == {"age": "z", "M": 9.0, "F": None}


def test_facet_histogram_of_one_value(spark):
    df = spark.range(20).selectExpr("5D AS pay", "id")
    got = [(r["left"], r["count"]) for r in f.facet_histogram(df, f.FilterSet(), "pay", bins=4).orderBy("bin").collect()]
    assert got == [(4.5, 0), (4.75, 0), (5.0, 20), (5.25, 0)]
    assert sum(r["count"] for r in f.facet_histogram(df, f.FilterSet(), "pay", 5, 5, 3).collect()) == 20


def test_filled_values_are_not_found_as_text(spark):
    df = f.fill_not_given(spark.createDataFrame([("x",), (None,), ("",)], "s string"), ["s"])
    assert [r[0] for r in rows(df.where(f.text_search("s", "any")))] == ["x"]
    assert [r[0] for r in rows(df.where(f.text_search("s", "none")))] == ["", "N/A"]


def test_pivot_keeps_rows_without_a_listed_answer(spark):
    df = spark.createDataFrame([("A", "1", 5, 10.0), ("B", "9", 5, 10.0), ("C", None, 5, 10.0), (None, "1", 5, 1.0)], "firm string, years string, sat int, pay double")
    got = {r["firm"]: r.asDict() for r in a.pivot_matrices(df, "firm", "years", ["1", "2"], "sat", "pay").collect()}
    assert sorted(got) == ["A", "B", "C"]
    assert (got["A"]["count_1"], got["A"]["median_1"], got["B"]["count_1"], got["C"]["count_2"], got["C"]["mean_1"]) == (1, 10.0, 0, 0, None)
