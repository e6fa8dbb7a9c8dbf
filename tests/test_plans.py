"""What the plans of all queries may and may not contain."""

import re

import pytest

import __spark_entry__ as contract
from paylens.operators import joins as j
from paylens.workloads import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan_stays_in_the_engine(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    for banned in ("PythonUDF", "MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert banned not in text
    # no table without a known size takes part in a join
    assert "Scan ExistingRDD" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["min_threshold"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_totalprice,10000", text)
    assert "o_orderpriority" not in text


def test_medians_shuffle_counts_once(spark):
    df = contract.queries()["median_by_group"](spark, FOLDER)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    # the wanted column and its groups, nothing else
    assert re.search(r"hashpartitioning\(year#\d+L, firm_type#\d+, _v#\d+", final)


def test_dedup_combines_before_the_shuffle(spark):
    text = plan(contract.queries()["dedup_keep_first"](spark, FOLDER))
    assert "partial_min_by" in text and "SortAggregate" not in text


def test_whole_refresh_shuffles_responses_once(spark):
    text = plan(contract.queries()["survey_refresh"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning(Job Satisfaction") == 1
    assert "SortMergeJoin" not in text


def test_facets_scan_once(spark):
    text = plan(contract.queries()["facet_counts"](spark, FOLDER))
    assert text.count("orders.parquet") == 1


def test_hexagons_read_the_responses_twice(spark):
    df = contract.queries()["hexbin_stats"](spark, FOLDER)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("orders.parquet") <= 2


def test_duplicate_audit_is_a_hash_aggregate(spark):
    text = plan(contract.queries()["duplicate_audit"](spark, FOLDER))
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_large_lookups_share_their_hot_keys(spark):
    facts = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey AS k")
    dim = spark.read.parquet(f"{FOLDER}/customer.parquet").selectExpr("c_custkey AS k", "c_name AS a")
    hot = j.hot_keys(facts, ["k"])
    twice = j.lookup_join(j.lookup_join(facts, dim, "k", max_rows=1, hot=hot), dim.withColumnRenamed("a", "b"), "k", max_rows=1, hot=hot)
    assert plan(twice).count("orders.parquet") == 1
    assert twice.count() == facts.count()


def test_trend_reads_the_responses_twice(spark):
    df = contract.queries()["topn_median_trend"](spark, FOLDER)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("orders.parquet") <= 2
