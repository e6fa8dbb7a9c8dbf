"""Null rules, conversions, corrections, duplicates."""

import datetime as dt

import pytest

from paylens.functions import text as t
from paylens.operators import aggregates as a
from paylens.operators import cleaning as c
from paylens.operators.quantiles import group_median
from paylens.sources.literals import literal_table
from paylens.sources.survey import normalise_nulls
from tests.conftest import rows


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").selectExpr(expression).collect()[0][0]


def test_missing_texts(spark):
    df = spark.createDataFrame([("NA",), ("N/A",), ("",), ("null",), ("na",), ("-",), (None,)], "s string")
    assert rows(normalise_nulls(df)) == sorted([(None,)] * 5 + [("na",), ("-",)], key=repr)


def test_inequality_keeps_null(spark):
    df = spark.createDataFrame([("103",), (None,), ("26-30",)], "age string")
    assert rows(c.drop_equal(df, "age", "103")) == [("26-30",), (None,)]


def test_threshold_drops_null(spark):
    df = spark.createDataFrame([(9999,), (10000,), (None,)], "pay int")
    assert rows(c.min_threshold(df, "pay", 10000)) == [(10000,)]


def test_null_group_is_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("a", 4.0)], "k string, v double")
    assert rows(group_median(df, ["k"], "v")) == [("a", 2.5)]
    assert rows(a.count_by_group(df, ["k"])) == [("a", 2)]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(7, "x", None), (3, "x", None), (5, "x", "y"), (9, None, None)], "id int, p string, q string")
    once = c.dedup_keep_first(df)
    assert rows(once) == [(3, "x", None), (5, "x", "y"), (9, None, None)]
    assert rows(c.dedup_keep_first(once)) == rows(once)
    assert rows(c.duplicate_audit(df)) == [(3, "x", None, 2), (7, "x", None, 2)]


def test_dedup_by_other_order(spark):
    df = spark.createDataFrame([(1, 20, "x"), (2, 10, "x")], "id int, seq int, p string")
    assert rows(c.dedup_keep_first(df, seq="seq")) == [(2, 10, "x")]


def test_audit_of_one_hot_group(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 3000 THEN 'hot' ELSE CAST(id AS STRING) END AS p")
    audited = c.duplicate_audit(df, shares=8)
    assert audited.count() == 3000
    assert audited.selectExpr("count(DISTINCT id)", "min(copies)", "max(copies)").collect()[0] == (3000, 3000, 3000)


def test_literals_are_no_patterns(spark):
    df = spark.createDataFrame([("501 + People",), ("6-10 People",), (None,)], "s string")
    out = c.clean_literals(df, {"s": [(" People", ""), ("501 +", "501+")]})
    assert rows(out) == [("501+",), ("6-10",), (None,)]


@pytest.mark.parametrize(
    "stamp, wanted",
    [("Jun '24", dt.date(2024, 6, 1)), ("Jan '69", dt.date(1969, 1, 1)), ("Dec '68", dt.date(2068, 12, 1)), (None, None)],
)
def test_month_stamp(spark, stamp, wanted):
    assert one(spark, stamp, t.month_from_stamp("s")) == wanted


def test_bad_month_raises(spark):
    with pytest.raises(Exception):
        one(spark, "soon", t.month_from_stamp("s"))


def test_numbers(spark):
    assert one(spark, "1,234,567", t.parse_thousands("s")) == 1234567
    assert one(spark, "$1,000 or so", t.strip_to_number("s")) == 1000.0
    assert one(spark, "none", t.strip_to_number("s")) is None
    assert [one(spark, s, t.coerce_int("s")) for s in ("7", "7.0", " 7 ", "x", "", "nan", None)] == [7, 7, 7, None, None, None, None]


def test_bad_amount_raises(spark):
    with pytest.raises(Exception):
        one(spark, "lots", t.parse_thousands("s"))


def test_bad_batch_needs_all_three(spark):
    df = spark.createDataFrame(
        [("S", "Jun '24", "A"), (None, "Jun '24", "A"), ("S", None, "A"), ("S", "Jun '24", "B")], "school string, d string, place string"
    )
    assert len(rows(c.drop_bad_batch(df, "school", "d", "place", "Jun '24", "A"))) == 3


def test_annualise_full_time_only(spark):
    df = spark.createDataFrame(
        [(1, 30, "hour", "Full-time"), (2, 30, "hour", "Freelance"), (3, 30, "hour", None), (4, 30, "year", "Full-time")],
        "id int, pay bigint, unit string, status string",
    )
    assert [r[1] for r in rows(c.annualise(df, "pay", "unit", "status"))] == [62400, 30, 30, 30]


def test_currency_before_rename_and_half_even(spark):
    df = spark.createDataFrame(
        [(1, 105000, "CADyear"), (2, 100, "localcurrencyyear"), (3, 7, "year"), (4, 5, None), (5, 25, "half")],
        "id int, pay bigint, unit string",
    )
    out = c.fx_normalise(df, "pay", "unit", {"CADyear": 0.72, "localcurrencyyear": 1.0, "half": 0.5})
    assert rows(out) == [(1, 75600, "year"), (2, 100, "year"), (3, 7, "year"), (4, 5, None), (5, 12, "year")]
    assert out.schema["pay"].dataType.simpleString() == "bigint"


def test_corrections_touch_listed_fields_only(spark):
    df = spark.createDataFrame([(1, 10, "hour"), (2, 20, None), (3, 30, "year")], "id bigint, pay bigint, unit string")
    fixes = literal_table(spark, [(1, 99, None), (2, None, "year"), (8, 1, "x")], "id bigint, pay bigint, unit string")
    assert rows(c.apply_corrections(df, fixes)) == [(1, 99, "hour"), (2, 20, "year"), (3, 30, "year")]


def test_denied_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id bigint")
    assert rows(c.drop_ids(df, [1, 5])) == [(2,), (None,)]
    assert rows(c.drop_ids(df, [])) == [(1,), (2,), (None,)]
    assert rows(c.drop_ids(df, literal_table(spark, [(1,), (5,)], "id bigint"))) == [(2,), (None,)]


def test_allowlist(spark):
    df = spark.createDataFrame([("year",), ("hour",), ("CHFyear",), (None,), (None,)], "unit string")
    kept, rejected = c.allowlist_split(df, "unit", ["year", "hour"])
    assert rows(kept) == [("hour",), ("year",)]
    assert rows(rejected) == [("CHFyear", 1), (None, 2)]


def test_audits(spark):
    df = spark.createDataFrame([("1,000", "Full-time"), ("1000 EUR", None), (None, "Part-time")], "bonus string, status string")
    assert rows(c.pattern_audit(df, "bonus", "[^0-9,]"), "bonus") == [("1000 EUR",)]
    assert c.quality_report(df, {"no_bonus": "bonus IS NULL"}).collect()[0] == (3, 1)
    assert c.status_breakdown(df, "status", ["Full-time", "Part-time"]).collect()[0].asDict() == {
        "full_time": 1, "part_time": 1, "not_specified": 1
    }


def test_midpoints_and_remap(spark):
    df = spark.createDataFrame([("< 1",), ("31- >40",), (None,), ("?",)], "y string")
    assert rows(c.bucket_midpoint(df, "y", {"< 1": 0.5}, "m"), "m") == sorted([(0.5,), (None,), (None,), (None,)], key=repr)
    assert rows(c.remap_values(df, "y", {"31- >40": "31-40"})) == [("31-40",), ("< 1",), ("?",), (None,)]


def test_school_name(spark):
    df = spark.createDataFrame([("University of Hawai`i at M?noa",), ("Other",)], "s string")
    out = c.regex_repair(df, ["s"], "University of Hawai.i at M.noa", "University of Hawaiʻi at Mānoa")
    assert ("University of Hawaiʻi at Mānoa",) in rows(out)


@pytest.mark.parametrize("shares", [1, 63, 65, 300])
def test_audit_with_any_number_of_parts(spark, shares):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN id DIV 6 ELSE id END AS a", "id % 3 AS b")
    got = {r["id"]: r["copies"] for r in c.duplicate_audit(df, shares=shares).collect()}
    groups = {}
    for i, a, b in df.collect():
        groups.setdefault((a, b), []).append(i)
    assert got == {i: len(g) for g in groups.values() if len(g) > 1 for i in g}
