"""Envelopes read in pieces against the same files read as a whole."""

import json
import random

import pytest

from paylens.sources.envelopes import envelope_pieces, read_split_envelopes
from paylens.sources.survey import read_envelopes


def compact(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def pairs(n, seed=0):
    draw = random.Random(seed)
    return [[f"{seed}-{i}", "<p>" + draw.choice(['say "],["', "\\", 'a"b', "\n\t", "é…", "]]", '"]],"', "{", '","']) * draw.randrange(1, 60) + "</p>"] for i in range(n)]


FILES = {
    "plain.json": compact({"iTotalRecords": 400, "aaData": pairs(400, 1)}),
    "members-behind.json": compact({"aaData": pairs(300, 2), "iTotalRecords": 300, "sEcho": "x"}),
    "spaced.json": json.dumps({"iTotalRecords": 50, "aaData": pairs(50, 3)}, indent=1),
    "one.json": compact({"aaData": pairs(1, 4)}),
    "none.json": compact({"aaData": []}),
    "null.json": compact({"aaData": None, "iTotalRecords": 0}),
    "no-ids.json": compact({"aaData": [["", "a"], ["5-1", "b"], [None, "c"], ["5-2", None], [7, "d"], [], ["5-3"], ["5-4", "e", "more"], None, ["5-5", "f"]] * 40}),
    "lists-before.json": compact({"columns": [["a"], ["b"]], "aaData": pairs(60, 6)}),
    "lists-behind.json": compact({"aaData": pairs(60, 7), "columns": [["a", "b"], ["c", "d"]]}),
    "deep-behind.json": compact({"aaData": pairs(60, 8), "columns": [[["a"], ["b", 5]]]}),
    "two-roots.json": compact({"aaData": pairs(40, 9)}) + "\n" + compact({"aaData": pairs(40, 10)}),
    "list-of-two.json": compact([{"aaData": pairs(40, 11)}, {"aaData": pairs(40, 12)}]),
    "cut-off.json": compact({"aaData": pairs(100, 13)})[:-500],
    "braces.json": compact({"aaData": [["{", ":5}"], ["{", "x"], ['{"aaData":', "[["], ["}", "y"]] * 30}),
    "not-a-pair.json": compact({"aaData": [*pairs(30, 14), 5, *pairs(30, 15)]}),
    "empty.json": "",
}


def found(df):
    got = df.selectExpr("id", "html", "landed.file AS file", "landed.place AS place").collect()
    return sorted((r["file"].rsplit("/", 1)[1], r["place"], r["id"], r["html"]) for r in got)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("envelopes")
    for name, text in FILES.items():
        (path / name).write_text(text, encoding="utf-8")
    return path


@pytest.mark.parametrize("split", ["128m", "3000b"])
def test_pieces_give_what_whole_files_give(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_split_envelopes(spark, str(folder))
        want = found(read_envelopes(spark, str(folder)))
        assert found(df) == want and len(want) > 1000
        assert df.dtypes == read_envelopes(spark, str(folder)).dtypes
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", sorted(FILES))
def test_each_file_alone(spark, folder, name):
    assert found(read_split_envelopes(spark, f"{folder}/{name}")) == found(read_envelopes(spark, f"{folder}/{name}"))


def test_a_file_of_several_splits_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(compact({"iTotalRecords": 5000, "aaData": pairs(5000, 20)}), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000b")
    try:
        pieces = envelope_pieces(spark, str(tmp_path))
        tasks = pieces.groupBy("block").count().collect()
        assert len(tasks) > 5 and max(r["count"] for r in tasks) < 2500
        assert read_envelopes(spark, str(tmp_path)).rdd.getNumPartitions() == 1 < pieces.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_files_are_read_again_where_all_are_compact(spark, folder):
    df = read_split_envelopes(spark, f"{folder}/plain.json")
    assert "json" not in df._jdf.queryExecution().optimizedPlan().toString().lower().replace("plain.json", "").replace("from_json", "")
