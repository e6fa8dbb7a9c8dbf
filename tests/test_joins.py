"""Lookups with and without a broadcast, under a hot key."""

import pytest

from paylens.operators import joins as j
from paylens.operators.aggregates import topn_values
from tests.conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    return spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 20) END AS Location"
    )


@pytest.fixture(scope="module")
def places(spark):
    return spark.range(15).selectExpr("concat('k', id) AS Location", "CAST(id AS DOUBLE) AS Latitude", "-CAST(id AS DOUBLE) AS Longitude").union(
        spark.sql("SELECT 'hot', 99D, -99D")
    )


def test_both_ways_agree(facts, places):
    small = j.lookup_join(facts, places, "Location")
    large = j.lookup_join(facts, places, "Location", max_rows=3)
    assert "_share" in large._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert small.columns == large.columns
    assert rows(small) == rows(large)
    assert small.count() == 3000


def test_hot_keys_are_the_frequent_ones(facts):
    assert {r[0] for r in j.hot_keys(facts, ["Location"], one_in=10).table.collect()} == {"hot"}
    assert {r[0] for r in j.hot_keys(facts, ["Location"], one_in=2).table.collect()} == set()


@pytest.mark.parametrize("listed", [True, False])
def test_hot_key_and_null_are_spread(facts, places, listed):
    hot = j.hot_keys(facts, ["Location"], one_in=10) if listed else None
    joined = j.salted_join(facts, places, ["Location"], shares=16, hot=hot)
    assert rows(joined) == rows(facts.join(places, "Location", "left"))
    per_task = facts.selectExpr("*", f"{j.share_of(facts.columns, 16)} AS s").groupBy("Location", "s").count()
    for key in ("Location = 'hot'", "Location IS NULL"):
        assert per_task.where(key).count() == 16
        assert per_task.where(key).selectExpr("max(count)").collect()[0][0] < 150


def test_null_keys_never_match(facts, places, spark):
    with_null = places.union(spark.sql("SELECT CAST(NULL AS STRING), 1D, 1D"))
    assert j.enrich_location(facts, with_null).where("Location IS NULL AND Latitude IS NOT NULL").count() == 0


def test_unresolved_and_gazetteer(facts, places, spark):
    cache = places.where("Latitude < 10")
    assert [r[0] for r in rows(j.unresolved_keys(facts, cache))] == sorted(["hot"] + [f"k{i}" for i in range(10, 20)])
    enriched = j.enrich_location(facts, cache)
    found, missing = j.fill_from_gazetteer(enriched, places)
    assert {r[0] for r in missing.select("Location").distinct().collect()} == {None, "k15", "k16", "k17", "k18", "k19"}
    assert found.count() + missing.count() == 3000
    assert found.where("Latitude IS NULL OR Longitude IS NULL").count() == 0


def test_topn_semi(facts):
    top = topn_values(facts, "Location", 2, "id")
    kept = j.topn_semi(facts, top, "Location")
    assert {r[0] for r in kept.select("Location").distinct().collect()} == {r[0] for r in top.select("Location").collect()}


def test_null_has_as_many_shares_as_its_rows_ask_for(spark):
    facts = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('k', id) END AS Location")
    few, many = (j.hot_keys(facts, ["Location"], tasks=t).null_shares for t in (3, 600))
    assert (few, many) == (3, 401)
    assert j.hot_keys(facts.where("Location IS NOT NULL"), ["Location"], tasks=600).null_shares == 1
    assert j.hot_keys(facts.where("FALSE"), ["Location"]).null_shares == 1


def test_the_refresh_counts_the_keys_of_two_large_lookups_once(spark, monkeypatch):
    from paylens.workloads.refreshing import survey_refresh

    folder = "/root/testdata/sf0.001"
    want = rows(survey_refresh(spark, folder))
    counted = []
    monkeypatch.setattr(j, "small_enough", lambda dim, max_rows=0, max_bytes=0: False)
    whole = j.hot_keys
    monkeypatch.setattr(j, "hot_keys", lambda *a, **k: counted.append(a) or whole(*a, **k))
    assert rows(survey_refresh(spark, folder)) == want
    assert len(counted) == 1
