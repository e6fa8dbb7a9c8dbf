"""Operators for tables that grow: stored rankings, merged landings, heavy values, long series, gates."""

import datetime as dt
import random

import pytest

from paylens.operators import timeseries as ts
from paylens.operators.aggregates import topn_values
from paylens.operators.cleaning import dedup_keep_first, quality_report
from paylens.operators.heavy import heavy_topn
from paylens.operators.landings import landing_state, merge_states, unseen
from paylens.operators.pages import open_ranked, page_of, store_ranked
from paylens.operators.ranking import global_rank
from paylens.schema import COORDINATES_SCHEMA
from paylens.sources.sinks import BrokenInvariant, append_cache, read_cache, require, write_checked
from tests.conftest import rows


def test_pages_are_slices_of_the_ranking(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7D WHEN id % 50 = 1 THEN NULL ELSE CAST(id * 7919 % 1009 AS DOUBLE) END AS v")
    path = str(tmp_path / "ranked")
    store_ranked(df, "v", "id", path, ascending=False, block=300)
    stored = open_ranked(spark, path)
    whole = {r["rank"]: (r["id"], r["v"]) for r in global_rank(df, "v", "id", ascending=False).collect()}
    assert stored.count() == 5000
    for page, size in ((0, 10), (3, 100), (49, 100), (50, 100), (2, 450), (0, 5000)):
        got = [(r["id"], r["v"]) for r in page_of(stored, page, size, block=300).collect()]
        assert got == [whole[i] for i in range(page * size, min(5000, (page + 1) * size))]
    files = page_of(stored, 3, 100, block=300).inputFiles()
    plan = page_of(stored, 3, 100, block=300)._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [isnotnull(block" in plan


def test_landings_in_any_order_give_what_one_pass_gives(spark):
    draw = random.Random(2)
    data = [(i, draw.choice(["a", "a", "b", None, ""]), draw.choice([1, 2, None]), draw.choice(["x,1:y", "x", None])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, a string, b int, c string")
    parts = [landing_state(df.where(f"id % 4 = {i}")) for i in range(4)]
    want = rows(dedup_keep_first(df).select("id", "a", "b", "c"))
    counts = {tuple(r[:3]): r[3] for r in df.groupBy("a", "b", "c").count().collect()}
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        state = parts[order[0]]
        for i in order[1:]:
            state = merge_states(state, parts[i])
        assert rows(state.selectExpr("first_id AS id", "a", "b", "c")) == want
        assert {(r["a"], r["b"], r["c"]): r["copies"] for r in state.collect()} == counts
    assert rows(merge_states(merge_states(parts[0], parts[1]), merge_states(parts[2], parts[3]))) == rows(landing_state(df))
    had = {tuple(r) for r in df.where("id % 4 = 1").select("a", "b", "c").collect()}
    new = {(r["a"], r["b"], r["c"]) for r in unseen(parts[1], parts[0]).collect()}
    assert new == {tuple(r) for r in df.where("id % 4 = 0").select("a", "b", "c").collect()} - had


def test_equal_digests_are_compared_on_their_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, a string")
    state = landing_state(df).selectExpr("'same' AS digest", "a", "first_id", "first_seen", "copies")
    assert merge_states(state, state).count() == 2
    assert [r["a"] for r in unseen(state.where("a = 'a'"), state).collect()] == ["b"]


@pytest.mark.parametrize("case", ["skewed", "flat", "ties", "few", "empty", "numbers"])
@pytest.mark.parametrize("tracked", [64, 4096])
def test_heavy_values_are_those_of_a_full_count(spark, case, tracked):
    value = {
        "skewed": "CASE WHEN id % 4 = 0 THEN 'hot' WHEN id % 4 = 1 THEN concat('w', id % 7) ELSE concat('c', id) END",
        "flat": "concat('v', id)",
        "ties": "concat('v', id % 40)",
        "few": "CASE WHEN id % 3 > 0 THEN concat('v', id % 3) END",
        "empty": "CAST(NULL AS STRING)",
        "numbers": "CASE WHEN id % 2 = 0 THEN id % 6 ELSE id END",
    }[case]
    df = spark.range(20_000).selectExpr("20000 - id AS id", f"{value} AS v")
    for n in (1, 3, 12):
        assert [tuple(r) for r in heavy_topn(df, "v", n, "id", tracked).collect()] == [tuple(r) for r in topn_values(df, "v", n, "id").collect()]


def test_heavy_values_need_no_full_count(spark, monkeypatch):
    from paylens.operators import heavy

    seen, whole = [], heavy.topn_values
    monkeypatch.setattr(heavy, "topn_values", lambda df, *a: seen.append(df) or whole(df, *a))
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN concat('h', id % 8) ELSE concat('c', id) END AS v")
    assert heavy_topn(df, "v", 4, "id", 64).count() == 4
    assert len(seen) == 1 and seen[0].select("v").distinct().count() < 200


@pytest.mark.parametrize("segments", [None, 1, 2, 7, 50])
def test_long_series_are_filled_as_short_ones(spark, segments):
    draw, data = random.Random(5), []
    for name, n, gap in (("long", 900, 0.5), ("holes", 300, 0.95), ("one", 1, 0.0), ("none", 40, 1.0), ("edges", 100, 0.4), (None, 30, 0.3)):
        for i in range(n):
            missing = draw.random() < gap or (name == "edges" and not 30 < i < 60)
            data.append((name, dt.date(2000, 1, 1) + dt.timedelta(days=3 * i + draw.randrange(3)), None if missing else draw.uniform(0, 100)))
    df = spark.createDataFrame(data, "series_id string, date date, value double").repartition(3)
    got, want = rows(ts.interpolate_long(df, segments=segments)), rows(ts.interpolate_gaps(df))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [-1.0 if r[2] is None else r[2] for r in got] == pytest.approx([-1.0 if r[2] is None else r[2] for r in want], rel=1e-12)
    assert rows(ts.interpolate_long(df.where("FALSE"), segments=segments)) == []


def test_a_row_looks_at_few_cut_points(spark):
    """The segment of a row is found by halving, not by a look at each cut point."""
    cuts = sorted({float(x) for x in (-3, 0, 1, 1.5, 7, 8, 20, 400, 1e9)})
    for n in range(1, len(cuts) + 1):
        e = ts._cuts_up_to("CAST(id AS DOUBLE) / 2", cuts[:n])
        got = spark.range(-10, 60).selectExpr("id / 2D AS t", f"{e} AS n").collect()
        assert all(r["n"] == sum(c <= r["t"] for c in cuts[:n]) for r in got)
    df = spark.range(3000).selectExpr("'s' AS series_id", "id AS at", "nullif(id % 3, 0) * 1D AS value")
    plan = ts.interpolate_long(df, "at", segments=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "aggregate(" in plan


def test_no_window_holds_a_long_series(spark):
    df = spark.range(100_000).selectExpr("'s' AS series_id", "CAST(id AS DOUBLE) AS at", "CASE WHEN id % 7 > 0 THEN CAST(id AS DOUBLE) END AS value")
    plan = ts.interpolate_long(df, "at")._jdf.queryExecution().executedPlan().toString()
    assert "_seg" in plan
    filled = ts.interpolate_long(df, "at")
    assert filled.where("at >= 1 AND abs(value - at) > 1e-6").count() == 0 and filled.where("value IS NULL").count() == 1


def test_a_broken_rule_stops_the_write(spark, tmp_path):
    out, day = str(tmp_path / "out"), dt.date(2026, 5, 18)
    df = spark.range(4).selectExpr("id", "nullif(id, 2) AS pay")
    report = quality_report(df, {"missing_pay": "pay IS NULL"})
    write_checked(df, report, {"some rows": "rows > 0", "few missing": "missing_pay <= 1"}, out, day)
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(BrokenInvariant, match="no pay missing.*missing_pay\":1"):
        write_checked(spark.range(9), report, {"some rows": "rows > 0", "no pay missing": "missing_pay = 0"}, out, day)
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(BrokenInvariant, match="unknown"):
        require(report, {"unknown": "NULL"})
    with pytest.raises(BrokenInvariant):
        require(report.where("FALSE"), {"any": "TRUE"})


def test_a_key_appended_twice_is_read_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("A", 1.0, 2.0)], COORDINATES_SCHEMA).write.parquet(path)
    before = spark.read.parquet(path)
    found = spark.createDataFrame([("B", 3.0, 4.0), ("B", 2.0, 9.0)], COORDINATES_SCHEMA)
    append_cache(found, before, path)
    append_cache(found, before, path)  # a run that began before the other had ended
    assert spark.read.parquet(path).count() == 3
    assert rows(read_cache(spark, path)) == [("A", 1.0, 2.0), ("B", 2.0, 9.0)]
