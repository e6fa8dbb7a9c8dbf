"""The batch job on a handful of responses."""

import pytest

from paylens.plans.extract import extract_cards
from paylens.plans.refresh import Rules, clean_responses, refresh
from paylens.schema import CLEAN_SCHEMA, COORDINATES_SCHEMA, RAW_SCHEMA
from paylens.sources.series import as_series
from tests.conftest import rows
from tests.test_extract import CARD

BASE = {
    "id": "1", "Job Satisfaction": "7", "Salary": "60,000", "Salary Unit": "peryear", "Location": "Chicago, IL, US",
    "Job Title": "Designer", "Firm Type": "Boutique", "Firm Size": "501 + People", "Vacation Days": "15", "Annual Bonus": "1,000",
    "Work Status": "Full-time", "Years of Experience": "3-5", "Age": "26-30", "Gender": "Gender: Other", "Licensed": "Licensed",
    "Undergraduate School": "UG:University of Hawai?i at M?noa", "Date": "Dec '24",
}


def raw(spark, *changes):
    data = [{**BASE, **c} for c in changes]
    return spark.createDataFrame([tuple(d.get(f.name) for f in RAW_SCHEMA.fields) for d in data], RAW_SCHEMA)


@pytest.fixture(scope="module")
def dims(spark):
    cache = spark.createDataFrame([("Chicago, IL, US", 41.9, -87.6)], COORDINATES_SCHEMA)
    gazetteer = spark.createDataFrame([("Boston, MA, US", 42.4, -71.1)], COORDINATES_SCHEMA)
    months = [("2024-12-01", 317.604), ("2025-09-01", 324.245), ("2025-10-01", None), ("2025-11-01", 325.063), ("2026-04-01", 332.407)]
    cpi = as_series(spark.createDataFrame(months, "d string, v double"), "cpi", "d", "v")
    return cache, gazetteer, cpi


def test_whole_job(spark, dims):
    responses = raw(
        spark,
        {"id": "1"},
        {"id": "2"},  # a second submit of the same answers
        {"id": "3", "Age": "103"},
        {"id": "4", "Age": None, "Location": "Boston, MA, US", "Date": "Oct '25"},
        {"id": "5", "Location": "Atlantis", "Job Title": "Diver"},
        {"id": "6", "Work Status": "Part-time"},
        {"id": "7", "Work Status": None, "Salary": "9,999"},
        {"id": "8", "Salary": "30", "Salary Unit": "perhour"},
        {"id": "9", "Salary": "30", "Salary Unit": "perhour", "Work Status": "Freelance"},
        {"id": "10", "Salary": "100,001", "Salary Unit": "CADperyear"},
        {"id": "11", "Salary Unit": "CHFperyear"},
        {"id": "12", "Job Satisfaction": "unsure"},
        {"id": "13", "Date": "Jun '26", "Years of Experience": "40", "Annual Bonus": "none"},
        {"id": "14", "Date": "Jun '24", "Location": "Austin, TX, US", "Post-Graduate School": "PhD: X"},
        {"id": "12734", "Job Title": "a"},
        {"id": "3616", "Job Title": "b"},
        {"id": "17102", "Job Title": "c", "Salary": "105,000", "Salary Unit": "CADperyear"},
        {"id": "4576", "Job Title": "d"},
    )
    result = refresh(responses, *dims)
    got = {r["id"]: r for r in result.clean.collect()}
    assert sorted(got) == [1, 4, 8, 10, 13, 4576, 17102]
    assert [(f.name, f.dataType) for f in result.clean.schema.fields] == [(f.name, f.dataType) for f in CLEAN_SCHEMA.fields]
    first = got[1].asDict()
    assert (first["Salary"], first["Salary Unit"], first["Firm Size"], first["Location"]) == (60000, "year", "501+", "Chicago, IL")
    assert (first["Gender"], first["Licensed"], first["Undergraduate School"]) == ("Other", "Yes", "University of Hawaiʻi at Mānoa")
    assert (first["Annual Bonus"], first["Vacation Days"], first["Year"], str(first["Date"])) == (1000.0, 15.0, 2024, "2024-12-01")
    assert first["Inflation Adjusted Salary"] == 62800.0
    assert got[4]["Latitude"] == 42.4 and got[4]["CPIAUCSL"] == pytest.approx(324.654) and got[4]["Inflation Adjusted Salary"] == 61400.0
    assert (got[8]["Salary"], got[8]["Salary Unit"]) == (62400, "hour")
    assert (got[10]["Salary"], got[10]["Salary Unit"]) == (72001, "year")
    assert (got[13]["CPIAUCSL"], got[13]["Inflation Adjusted Salary"], got[13]["Years of Experience"], got[13]["Annual Bonus"]) == (332.407, 60000.0, "> 40", None)
    assert (got[17102]["Salary"], got[17102]["Salary Unit"], got[17102]["Annual Bonus"]) == (75600, "year", 5760.0)
    assert got[4576]["Annual Bonus"] == 27000.0
    assert rows(result.unresolved_places) == [("Atlantis",), ("Boston, MA, US",)]
    assert rows(result.dropped_places, "id", "Location") == [(5, "Atlantis")]
    assert rows(result.rejected_units) == [("CHFyear", 1)]
    report = result.report.collect()[0].asDict()
    assert report == {
        "rows": 14, "missing_salary": 0, "missing_satisfaction": 1, "missing_coordinates": 1, "missing_index": 0,
        "dropped_satisfaction": 1, "dropped_part_time": 1, "dropped_pay": 2, "dropped_place": 1, "dropped_ids": 1, "dropped_unit": 1, "kept": 7,
    }
    assert report["kept"] == len(got)


def test_first_landed_response_stays(spark, dims):
    cards = [("20", CARD), ("3", CARD), ("9", "<p>no fields</p>")]
    landed = spark.createDataFrame([(i, h, ("f", n)) for n, (i, h) in enumerate(cards)], "id string, html string, landed struct<file:string,place:int>")
    typed = clean_responses(extract_cards(landed, keep=["landed"]))
    assert rows(typed, "id") == [(20,)] and "landed" not in typed.columns
    assert rows(clean_responses(extract_cards(landed)), "id") == [(3,)]


def test_experience_labels_join_the_ordered_category(spark):
    out = clean_responses(raw(spark, {"id": "1", "Years of Experience": "31- >40"}, {"id": "2", "Years of Experience": "31-"}))
    assert {r["Years of Experience"] for r in out.collect()} == {"31-40"}


def test_rules_can_be_changed(spark, dims):
    rules = Rules(minimum_pay=70000, spam_ages=())
    result = refresh(raw(spark, {"id": "1"}, {"id": "2", "Salary": "80,000", "Age": "103"}), *dims, rules=rules)
    assert rows(result.clean, "id", "Age") == [(2, "103")]


def test_stored_responses_give_the_same(spark, dims):
    responses = raw(spark, {"id": "1"}, {"id": "2", "Location": "Atlantis"})
    lazy, kept = refresh(responses, *dims), refresh(responses, *dims, store=True)
    assert rows(lazy.clean) == rows(kept.clean)
    assert rows(lazy.dropped_places, "id") == rows(kept.dropped_places, "id") == [(2,)]
    assert "table-" in kept.clean._jdf.queryExecution().executedPlan().toString()


def test_cards_to_clean_table(spark, dims):
    cards = spark.createDataFrame([("5", CARD.replace("Jun '24", "Dec '24"))], "id string, html string")
    got = refresh(extract_cards(cards), *dims).clean.collect()[0]
    assert (got["id"], got["Salary"], got["Firm Size"], got["Inflation Adjusted Salary"]) == (5, 60000, "6-10", 62800.0)
    assert (got["Licensed"], got["Graduate School"]) == ("No", "Other University")
