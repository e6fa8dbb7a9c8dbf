"""Whole-table orders against a plain sort."""

import random

import pytest

from paylens.operators.aggregates import category_rank
from paylens.operators.ranking import global_rank, listing_order, rank_buckets, rank_grid, sort_by_category


def expected(data, ascending):
    def key(row):
        seq, v = row
        return (v is None, 0 if v is None else v if ascending else -v, seq)

    return {seq: i for i, (seq, _) in enumerate(sorted(data, key=key))}


CASES = {
    "unique": lambda i, r: r.random() * 1e6,
    "hot value": lambda i, r: 5.0 if i % 3 else r.random() * 10,
    "hot null": lambda i, r: None if i % 3 else float(i % 17),
    "one value": lambda i, r: 1.0,
    "all null": lambda i, r: None,
    "hot and late": lambda i, r: 7.0 if i > 1200 else float(i % 40),
    "negative": lambda i, r: float(r.randrange(-50, 50)),
}


@pytest.mark.parametrize("buckets", [2, 7, 64])
@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("ascending", [True, False])
def test_rank(spark, case, ascending, buckets):
    r = random.Random(3)
    data = [(i * 10, CASES[case](i, r)) for i in range(2000)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "seq bigint, v double").repartition(4)
    got = {row["seq"]: row["rank"] for row in global_rank(df, "v", "seq", ascending, buckets).collect()}
    assert got == expected(data, ascending)


@pytest.mark.parametrize("hot", ["5D", "NULL"])
def test_buckets_stay_small_under_a_hot_value(spark, hot):
    df = spark.range(20000).selectExpr("id AS seq", f"CASE WHEN id % 3 = 0 THEN CAST(id AS DOUBLE) ELSE {hot} END AS v")
    sizes = rank_buckets(df, "v", "seq", True, 16).groupBy("_bucket", "_part").count()
    assert sizes.selectExpr("max(count)").collect()[0][0] <= 2 * 20000 / 16


def test_category_order_and_others_last(spark):
    df = spark.createDataFrame([(1, "c"), (2, "a"), (3, None), (4, "b"), (5, "zzz"), (6, "a")], "seq int, k string")
    assert [r["seq"] for r in sort_by_category(df, "k", ["a", "b", "c"], "seq").collect()] == [2, 6, 4, 1, 3, 5]
    place = category_rank("k", ["a", "b", "c"])
    got = {r["seq"]: r["rank"] for r in global_rank(df, place, "seq").collect()}
    assert got == {2: 0, 6: 1, 4: 2, 1: 3, 3: 4, 5: 5}


def test_listing_orders(spark):
    df = spark.createDataFrame([(1, "b", 5.0, 2020), (2, "a", 9.0, 2019), (3, "b", None, 2021)], "seq int, k string, pay double, Year int")

    def listed(by):
        return [r["seq"] for r in listing_order(df, by, "seq", {"k": ["a", "b"]}).collect()]

    assert listed("Year") == [1, 2, 3]
    assert listed("k") == [2, 1, 3]
    assert listed("pay") == [2, 1, 3]


def test_grid(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "rank bigint")
    got = [tuple(r) for r in rank_grid(df, 3, 10, 5, 2).orderBy("rank").collect()]
    assert got[4] == (4, 1, 1, 15.0, 12.0)
    assert got[6] == (6, 0, 2, 5.0, 22.0)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("buckets", [2, 16])
def test_whole_numbers_that_share_a_double(spark, ascending, buckets):
    """Ids and values above 2 ** 53, where neighbours become the same double, and one hot value among them."""
    r = random.Random(5)
    base = 2**53
    data = [(base + i, None if i % 50 == 0 else base + 7 if i % 3 else base + r.randrange(300)) for i in range(1200)]
    data += [(base + 5000 + i, 2**63 - 1 - i) for i in range(20)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "seq bigint, v bigint").repartition(4)
    got = {row["seq"]: row["rank"] for row in global_rank(df, "v", "seq", ascending, buckets).collect()}
    assert got == expected(data, ascending)
