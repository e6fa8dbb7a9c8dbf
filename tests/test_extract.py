"""Field extraction: list items, cards, character references."""

import pytest

from paylens.functions import text as t
from paylens.plans.extract import extract_cards
from paylens.sources.survey import read_envelopes
from tests.conftest import rows

NA = None

# Cases with known answers.
FIRM_CASES = [
    (["Individual", "16-30 People", "Health Insurance", "15 Days Vacation", "$1,000 Bonus"], ("Individual", "16-30 People", "Yes", NA, "15", "1,000")),
    (["Boutique", "6-10 People"], ("Boutique", "6-10 People", NA, NA, NA, NA)),
    (["101-200 People"], (NA, "101-200 People", NA, NA, NA, NA)),
    (["No Overtime"], (NA, NA, NA, "No Overtime", NA, NA)),
    (["Corporate", "31-50 People", "Health Insurance", "Unpaid Overtime", "15 Days Vacation", "$10,000 Bonus"], ("Corporate", "31-50 People", "Yes", "Unpaid Overtime", "15", "10,000")),
    # the first rule decides an item, the last item decides a field, empty items count for nothing
    (["", "Small", "Bonus People", "Large", "2-5 People"], ("Large", "2-5 People", NA, NA, NA, NA)),
    ([], (NA,) * 6),
]

PERSON_CASES = [
    (["Full-time", "3-5 Years of Experience", "26-30 Years old", "Male", "Licensed"], ("Full-time", "3-5", "26-30", "Male", "Licensed")),
    (["Full-time", "2 Years of Experience", "21-25 Years old", "Female"], ("Full-time", "2", "21-25", "Female", "No")),
    (["", "3-5 Years of Experience", "21-25 Years old", "Male"], (NA, "3-5", "21-25", "Male", "No")),
    (["Part-time", "8-10 Years of Experience", "26-30 Years old", "Female"], ("Part-time", "8-10", "26-30", "Female", "No")),
    (["Freelance", "11-15 Years of Experience", "46-50 Years old", "Male", "Licensed"], ("Freelance", "11-15", "46-50", "Male", "Licensed")),
    (["Full-time", "6-7 Years of Experience", "26-30 Years old", "Male"], ("Full-time", "6-7", "26-30", "Male", "No")),
    (["Full-time", "3-5 Years of Experience", "26-30 Years old", "Gender: Other"], ("Full-time", "3-5", "26-30", "Gender: Other", "No")),
    (["Full-time", "3-5 Years of Experience", "26-30 Years old", "Female"], ("Full-time", "3-5", "26-30", "Female", "No")),
    (["Full-time", "< 1 Years of Experience", "21-25 Years old", "Female"], ("Full-time", "< 1", "21-25", "Female", "No")),
    (["Full-time", "26-30 Years of Experience", "51-55 Years old", "Male", "Licensed"], ("Full-time", "26-30", "51-55", "Male", "Licensed")),
]


def classify(spark, cases, fields):
    df = spark.createDataFrame([(i, items) for i, (items, _) in enumerate(cases)], "i int, items array<string>")
    tags = t.firm_tags if fields is t.firm_fields else t.person_tags
    names = fields("tags")
    order = ["i", *names]
    return df.selectExpr("i", f"{tags('items')} AS tags").selectExpr("i", *[f"{e} AS {n}" for n, e in names.items()]).select(*order), order


def test_firm_items(spark):
    df, _ = classify(spark, FIRM_CASES, t.firm_fields)
    wanted = ["firm_type", "firm_size", "health_insurance", "overtime", "vacation_days", "annual_bonus"]
    got = df.orderBy("i").select(*wanted).collect()
    assert [tuple(r) for r in got] == [w for _, w in FIRM_CASES]


def test_person_items(spark):
    df, _ = classify(spark, PERSON_CASES, t.person_fields)
    wanted = ["work_status", "years_of_experience", "age", "gender", "licensed"]
    got = df.orderBy("i").select(*wanted).collect()
    assert [tuple(r) for r in got] == [w for _, w in PERSON_CASES]


CARD = """<img class="emoticon" data-original-title="Job Satisfaction: 7">
<h3><span class="salary">$60,000 per year</span><span class="slash">/</span> Chicago, IL, US
    <span class="slash">/</span> Project Designer</h3>
<ul class="subcol-1"><li>Boutique</li><li>6-10 People</li><li>Health Insurance</li></ul>
<ul class="subcol-2"><li>Full-time</li><li>3-5 Years of Experience</li><li>26-30 Years old</li><li> Male </li></ul>
<ul class="subcol-3"><li>UG: Sample University</li><li>Grad: Other University</li></ul>
<div class="date-stamp">Jun '24</div>"""


def test_card(spark):
    df = spark.createDataFrame([("17", CARD), ("18", "<p>nothing here</p>")], "id string, html string")
    full, empty = (r.asDict() for r in extract_cards(df).orderBy("id").collect())
    assert full == {
        "id": "17", "Job Satisfaction": "7", "Salary": "60,000", "Salary Unit": "peryear",
        "Location": "Chicago, IL, US", "Job Title": "Project Designer", "Firm Type": "Boutique",
        "Firm Size": "6-10 People", "Health Insurance": "Yes", "Overtime": None, "Vacation Days": None,
        "Annual Bonus": None, "Work Status": "Full-time", "Years of Experience": "3-5", "Age": "26-30",
        "Gender": "Male", "Licensed": "No", "Undergraduate School": "Sample University",
        "Graduate School": "Other University", "Post-Graduate School": None, "Date": "Jun '24",
    }
    assert {k: v for k, v in empty.items() if v is not None} == {"id": "18", "Licensed": "No"}


def test_spread_cards_give_the_same(spark):
    df = spark.range(40).selectExpr("CAST(id AS STRING) AS id").crossJoin(spark.createDataFrame([(CARD,)], "html string")).coalesce(1)
    spread = extract_cards(df)
    assert "REPARTITION_BY_COL" in spread._jdf.queryExecution().executedPlan().toString()
    assert rows(spread) == rows(extract_cards(df, spread=False))


def test_later_filters_stay_above_the_extraction(spark):
    df = spark.createDataFrame([("17", CARD)], "id string, html string")
    text = extract_cards(df).where("Salary = '60,000' AND Gender = 'Male'")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("data-original-title") == 1 and text.count("date-stamp") == 1


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&lt;b&gt;", "<b>"),
        ("caf&eacute; &#233; &#xE9;", "café é é"),
        ("&#128512;", "\U0001F600"),
        ("AT&T &bogus; &", "AT&T &bogus; &"),
        ("&#38;amp;", "&amp;"),
        ("it&apos;s", "it's"),
        ("plain", "plain"),
        (None, None),
        ("&#0000000039;x", "'x"),
        ("it&#146;s &#150; &#x80;", "it\u2019s \u2013 \u20ac"),
        ("&period;&NotEqualTilde;", ".\u2242\u0338"),
        ("A&nbspB caf&eacute", "A\xa0B caf\xe9"),
        ("&notit; &copyx &ampamp;", "\xacit; \xa9x &amp;"),
        ("&#0; &#xD800; &#99999999999; &#65", "\ufffd \ufffd \ufffd A"),
    ],
)
def test_entities(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.selectExpr(t.decode_entities("s")).collect()[0][0] == wanted


def test_plain_text_joins_stripped_pieces(spark):
    df = spark.createDataFrame([(" <b> A </b> B<!-- c > d -->\n",)], "s string")
    assert df.selectExpr(t.plain_text("s")).collect()[0][0] == "AB"


def test_classes_match_whole_words(spark):
    html = """<ul class='x subcol-10'><li>no</li></ul><ul class='x subcol-1 y'><li>yes</li></ul>"""
    df = spark.createDataFrame([(html,)], "s string")
    assert df.selectExpr(t.list_items(t.element("s", "ul", "subcol-1"))).collect()[0][0] == ["yes"]


def test_first_with_prefix(spark):
    df = spark.createDataFrame([(["Grad: B", "UG:  A ", "UG: C"],), (["x"],)], "items array<string>")
    assert rows(df.selectExpr(f"{t.first_with_prefix('items', 'UG:')} AS s")) == [("A",), (None,)]


def test_envelope_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"iTotalRecords": 3,\n "aaData": [["1", "<p>x</p>"], ["", "y"], ["2", "z"]]}')
    (tmp_path / "b.json").write_text('{"iTotalRecords": 1, "aaData": []}')
    got = read_envelopes(spark, str(tmp_path))
    assert rows(got, "id", "html") == [("1", "<p>x</p>"), ("2", "z")]
    assert [r["id"] for r in got.orderBy("landed").collect()] == ["1", "2"] and got.selectExpr("max(landed.place)").first()[0] == 2


def test_reference_names_are_dealt_to_small_maps(spark):
    """Every name is found in the map that the SQL picks, and no map holds many."""
    from html.entities import html5

    sizes = [0] * t._NAME_MAPS
    for name in html5:
        sizes[t._name_map(name)] += 1
    assert max(sizes) < 100
    names = spark.createDataFrame([(k, v) for k, v in html5.items()], "name string, wanted string").repartition(4)
    picked = names.selectExpr("wanted", "name", f"{t._entity_names()} AS names").selectExpr("wanted", f"try_element_at({t._names_of('name')}, name) AS found")
    assert picked.where("NOT wanted <=> found").count() == 0
