"""Readers and writers."""

import datetime as dt

import pytest

from paylens import session
from paylens.schema import CLEAN_SCHEMA, COORDINATES_SCHEMA, RAW_COLUMNS
from paylens.sources.literals import literal_table
from paylens.sources.sinks import append_cache, new_cache_rows, write_dated
from paylens.sources.survey import read_coordinates, read_responses, table_from_sheet
from tests.conftest import rows


def test_responses_file(spark, tmp_path):
    answers = {c: "NA" for c in RAW_COLUMNS}
    answers.update({"id": "7", "Job Title": '"Senior, ""Lead"""', "Salary": '"60,000"', "Gender": "", "Overtime": "None", "Age": "na"})
    (tmp_path / "raw.csv").write_text(",".join(RAW_COLUMNS) + "\n" + ",".join(answers[c] for c in RAW_COLUMNS) + "\n")
    got = read_responses(spark, str(tmp_path / "raw.csv")).collect()[0].asDict()
    assert {k: v for k, v in got.items() if v is not None} == {
        "id": "7", "Job Title": 'Senior, "Lead"', "Salary": "60,000", "Age": "na"
    }


def test_bad_coordinates_raise(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Location,Latitude,Longitude\n"Austin, TX, US",30.2,-97.7\n')
    assert rows(read_coordinates(spark, str(tmp_path / "c.csv"))) == [("Austin, TX, US", 30.2, -97.7)]
    (tmp_path / "d.csv").write_text("Location,Latitude,Longitude\nAustin,north,-97.7\n")
    with pytest.raises(Exception):
        read_coordinates(spark, str(tmp_path / "d.csv")).collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_dated_write_replaces_its_day_only(spark, tmp_path, fmt):
    out = str(tmp_path / "out")
    frame = lambda n: spark.range(n).selectExpr("id", "'a \"b\", c' AS t")
    write_dated(frame(3), out, dt.date(2026, 5, 18), fmt)
    write_dated(frame(5), out, dt.date(2026, 5, 19), fmt)
    write_dated(frame(2), out, dt.date(2026, 5, 18), fmt)
    reader = spark.read.option("header", True).option("escape", '"')
    back = reader.format(fmt).load(out)
    assert rows(back.groupBy("run_date").count()) == [(260518, 2), (260519, 5)]
    assert back.select("t").distinct().collect()[0][0] == 'a "b", c'


def test_cache_gets_new_keys_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("A", 1.0, 2.0)], COORDINATES_SCHEMA).write.parquet(path)
    found = spark.createDataFrame(
        [("A", 9.0, 9.0), ("B", 3.0, 4.0), ("B", 3.0, 4.0), ("C", None, None)], COORDINATES_SCHEMA
    )
    cache = spark.read.parquet(path)
    assert rows(new_cache_rows(found, cache)) == [("B", 3.0, 4.0)]
    append_cache(found, cache, path)
    cache = spark.read.parquet(path)
    append_cache(found, cache, path)
    assert rows(spark.read.parquet(path)) == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]


def test_sheet(spark):
    sheet = literal_table(
        spark,
        [("Title", None, None, None), ("Month", "Billings", "Inquiries", "x"), ("2025-01-01", "45.6", "51", "9"),
         ("2025-02-01", None, "n/a", "9"), ("Note: 2025", "1", "1", "1")],
        "c0 string, c1 string, c2 string, c3 string",
    )
    got = rows(table_from_sheet(sheet, "c0", {"c1": "Billings", "c2": "Inquiries"}))
    assert [(str(m), k, v) for m, k, v in got] == [
        ("2025-01-01", "Billings", 45.6), ("2025-01-01", "Inquiries", 51.0),
        ("2025-02-01", "Billings", None), ("2025-02-01", "Inquiries", None),
    ]


def test_literal_table(spark):
    df = literal_table(spark, [(1, "it's \\ ok", 1.5, dt.date(2020, 1, 2)), (None, None, None, None)], "a bigint, b string, c double, d date")
    assert rows(df) == [(1, "it's \\ ok", 1.5, dt.date(2020, 1, 2)), (None, None, None, None)]
    assert literal_table(spark, [], "a bigint").count() == 0


def test_schema_of_the_clean_table():
    assert [f.name for f in CLEAN_SCHEMA.fields][:21] == RAW_COLUMNS
    assert len(CLEAN_SCHEMA.fields) == 26


def test_checkpoint_dir(spark, tmp_path):
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        spark.conf.set("spark.checkpoint.dir", str(tmp_path / "shared"))
        try:
            assert str(tmp_path / "shared") in session.ensure_checkpoint_dir(spark)
        finally:
            spark.conf.unset("spark.checkpoint.dir")
    assert session.ensure_checkpoint_dir(spark) == sc.getCheckpointDir()


def test_cache_takes_no_null_key(spark):
    cache = spark.createDataFrame([("A", 1.0)], "Location string, Latitude double")
    found = spark.createDataFrame([(None, 2.0), ("B", 3.0)], "Location string, Latitude double")
    assert rows(new_cache_rows(found, cache)) == [("B", 3.0)]
