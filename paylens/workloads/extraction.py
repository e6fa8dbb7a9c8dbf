"""Fields out of markup, list items and JSON envelopes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paylens.functions import text as t
from paylens.functions.sql import q
from paylens.plans.extract import extract_cards as cards_to_responses
from paylens.schema import RAW_COLUMNS
from paylens.session import ensure_checkpoint_dir
from paylens.sources.envelopes import read_split_envelopes
from paylens.sources.survey import unwrap_text
from paylens.workloads.views import table

# Parts of a card by order number k, written for both engines.
K = "o_orderkey"
PARTS = {
    "segment": "c_mktsegment",
    "size": f"concat({K} % 50 + 1, '-', {K} % 50 + 5, ' People')",
    "health": f"CASE WHEN {K} % 3 = 0 THEN 'Health Insurance' ELSE '' END",
    "overtime": f"CASE {K} % 4 WHEN 0 THEN 'No Overtime' WHEN 1 THEN 'Unpaid Overtime' ELSE '' END",
    "vacation": f"concat({K} % 30, ' Days Vacation')",
    "bonus": f"concat('$', {K} % 100, ',000 Bonus')",
    "size_again": f"CASE WHEN {K} % 11 = 0 THEN '101-200 People' ELSE '' END",
    "status": f"CASE {K} % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Freelance' WHEN 2 THEN 'Part-time' ELSE '' END",
    "years": f"CASE {K} % 5 WHEN 0 THEN '< 1 Years of Experience' ELSE concat({K} % 5, '-', {K} % 5 + 2, ' Years of Experience') END",
    "age": f"concat({K} % 40 + 21, '-', {K} % 40 + 25, ' Years old')",
    "gender": f"CASE {K} % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Gender: Other' END",
    "licence": f"CASE WHEN {K} % 2 = 0 THEN 'Licensed' ELSE '' END",
    "college": "concat('UG: University of ', n_name)",
    "graduate": f"CASE WHEN {K} % 6 = 0 THEN concat('Grad:  ', n_name, ' College ') ELSE '' END",
    "pay": f"concat('$', {K}, ',500 per ', CASE WHEN {K} % 3 = 0 THEN 'hour' ELSE 'year' END)",
}
FIRM = ["segment", "size", "health", "overtime", "vacation", "bonus", "size_again"]
PERSON = ["status", "years", "age", "gender", "licence"]
SCHOOLS = ["graduate", "college"]


def parts(spark, folder):
    orders, customer, nation = (table(spark, folder, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(
        f"{K} AS k", "c_name", "n_name", "o_orderdate", *[f"{e} AS {name}" for name, e in PARTS.items()]
    )


PARTS_SQL = (
    f"p AS (SELECT {K} AS k, c_name, n_name, o_orderdate, "
    + ", ".join(f"{e} AS {name}" for name, e in PARTS.items())
    + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)


def classify_items_firm(spark, folder):
    items = parts(spark, folder).selectExpr("k AS id", f"array({', '.join(FIRM)}) AS items")
    tags = items.selectExpr("id", f"{t.firm_tags('items')} AS tags")
    return tags.selectExpr("id", *[f"{e} AS {name}" for name, e in t.firm_fields("tags").items()])


def classify_items_person(spark, folder):
    items = parts(spark, folder).selectExpr("k AS id", f"array({', '.join(PERSON)}) AS items")
    tags = items.selectExpr("id", f"{t.person_tags('items')} AS tags")
    return tags.selectExpr("id", *[f"{e} AS {name}" for name, e in t.person_fields("tags").items()])


def first_with_prefix(spark, folder):
    items = parts(spark, folder).selectExpr("k AS id", f"array({', '.join(SCHOOLS)}) AS items")
    return items.selectExpr(
        "id", f"{t.first_with_prefix('items', 'UG:')} AS college", f"{t.first_with_prefix('items', 'Grad:')} AS graduate"
    )


def _list(css, names):
    items = ", ".join(f"'<li>', replace({n}, '<', '&lt;'), '</li>'" for n in names)
    return f"'<ul class=\"{css}\">', {items}, '</ul>'"


CARD = f"""concat('<img class="emoticon big" data-original-title="Job Satisfaction: ', k % 10 + 1, '">',
    '<h3><span class="salary">', pay, '</span><span class="slash">/</span> ', n_name, ', US\n ',
    '<span class="slash">/</span> ', c_name, ' &amp; Partner</h3>',
    {_list('subcol-1', FIRM)}, {_list('subcol-2', PERSON)}, {_list('subcol-3', SCHOOLS)},
    '<div class="date-stamp"> ', date_format(o_orderdate, "MMM ''yy"), '</div>')"""


def landed_cards(spark, folder):
    """One survey card of markup per order."""
    return parts(spark, folder).selectExpr("CAST(k AS STRING) AS id", f"{CARD} AS html")


def extract_survey_cards(spark, folder):
    names = {c: c.lower().replace(" ", "_").replace("-", "_") for c in RAW_COLUMNS}
    return cards_to_responses(landed_cards(spark, folder)).selectExpr(*[f"{q(c)} AS {n}" for c, n in names.items()])


def extract_page_fields(spark, folder):
    pages = table(spark, folder, "pages").selectExpr(
        "page_id",
        f"{t.tag_attribute('html', 'html', 'lang')} AS lang",
        f"{t.plain_text(t.element('html', 'title'))} AS title",
        f"{t.plain_text(t.element('html', 'h1'))} AS heading",
        f"{t.list_items('html')} AS items",
    )
    return pages.selectExpr(
        "page_id", "lang", "title", "heading", "array_join(items, '|') AS items", "CAST(size(items) AS BIGINT) AS n_items"
    )


def json_envelope_explode(spark, folder):
    """Envelopes with one pair per event and one pair without an id."""
    envelope = """to_json(named_struct('iTotalRecords', 2L,
        'aaData', array(array(CAST(event_id AS STRING), props), array('', event_type)))) AS envelope"""
    pairs = unwrap_text(table(spark, folder, "events").selectExpr(envelope), "envelope")
    return pairs.selectExpr(
        "CAST(id AS BIGINT) AS id", "html AS payload", "CAST(get_json_object(html, '$.k') AS BIGINT) AS k"
    )


def json_envelope_split(spark, folder):
    """The same pairs out of landed files, which the cluster writes first: envelopes of 5,000 events each, read in pieces."""
    pair = "named_struct('k', event_id, 'pair', array(CAST(event_id AS STRING), props))"
    lists = (
        table(spark, folder, "events")
        .selectExpr("CAST(floor(event_id / 5000) AS INT) AS part", f"{pair} AS p")
        .groupBy("part")
        .agg(F.expr("transform(array_sort(collect_list(p)), x -> x.pair) AS pairs"))
    )
    landing = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    envelope = "to_json(named_struct('iTotalRecords', size(pairs), 'aaData', pairs)) AS value"
    lists.selectExpr("part", envelope).write.partitionBy("part").text(landing)
    pairs = read_split_envelopes(spark, landing)
    return pairs.selectExpr(
        "CAST(id AS BIGINT) AS id", "html AS payload", "CAST(get_json_object(html, '$.k') AS BIGINT) AS k",
        "CAST(regexp_extract(landed.file, 'part=([0-9]+)', 1) AS BIGINT) AS part", "CAST(landed.place AS BIGINT) AS place",
    )


_FIRM_SQL = """segment AS firm_type, CASE WHEN size_again <> '' THEN size_again ELSE size END AS firm_size,
    CASE WHEN health <> '' THEN 'Yes' END AS health_insurance, nullif(overtime, '') AS overtime,
    replace(vacation, ' Days Vacation', '') AS vacation_days, replace(replace(bonus, '$', ''), ' Bonus', '') AS annual_bonus"""
_PERSON_SQL = """nullif(status, '') AS work_status, CASE WHEN contains(years, '<') THEN '< 1' ELSE split_part(years, ' ', 1) END AS years_of_experience,
    split_part(age, ' ', 1) AS age, gender, CASE WHEN licence <> '' THEN 'Licensed' ELSE 'No' END AS licensed"""


def _clean(markup):
    """Plain text in DuckDB: tags off, the references that occur in the pages decoded."""
    plain = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{reference}', '{character}')"
    return f"trim({plain})"


QUERIES = {
    "classify_items_firm": (classify_items_firm, f"WITH {PARTS_SQL} SELECT k AS id, {_FIRM_SQL} FROM p"),
    "classify_items_person": (classify_items_person, f"WITH {PARTS_SQL} SELECT k AS id, {_PERSON_SQL} FROM p"),
    "first_with_prefix": (
        first_with_prefix,
        f"""WITH {PARTS_SQL} SELECT k AS id, replace(college, 'UG: ', '') AS college,
        CASE WHEN graduate <> '' THEN trim(replace(graduate, 'Grad: ', '')) END AS graduate FROM p""",
    ),
    "extract_survey_cards": (
        extract_survey_cards,
        f"""WITH {PARTS_SQL} SELECT CAST(k AS VARCHAR) AS id, CAST(k % 10 + 1 AS VARCHAR) AS job_satisfaction,
        regexp_replace(pay, '[^0-9,]', '', 'g') AS salary, regexp_replace(pay, '[^a-zA-Z]', '', 'g') AS salary_unit,
        concat(n_name, ', US') AS location, concat(c_name, ' & Partner') AS job_title, {_FIRM_SQL}, {_PERSON_SQL},
        replace(college, 'UG: ', '') AS undergraduate_school,
        CASE WHEN graduate <> '' THEN trim(replace(graduate, 'Grad:', '')) END AS graduate_school,
        CAST(NULL AS VARCHAR) AS post_graduate_school, strftime(o_orderdate, '%b ''%y') AS date FROM p""",
    ),
    "extract_page_fields": (
        extract_page_fields,
        f"""SELECT page_id, nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS lang,
        {_clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
        {_clean("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
        array_to_string(regexp_extract_all({_clean("replace(array_to_string(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), chr(1)), '|', chr(2))")}, '[^' || chr(1) || ']+'), '|') AS items,
        CAST(len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS BIGINT) AS n_items FROM pages""",
    ),
    "json_envelope_explode": (
        json_envelope_explode,
        "SELECT event_id AS id, props AS payload, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "json_envelope_split": (
        json_envelope_split,
        """SELECT event_id AS id, props AS payload, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id // 5000 AS part,
        row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) - 1 AS place FROM events""",
    ),
}
