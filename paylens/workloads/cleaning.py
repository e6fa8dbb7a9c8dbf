"""Filters, repairs, conversions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.functions import text as t
from paylens.operators import cleaning as c
from paylens.operators.landings import landing_state, merge_states, unseen
from paylens.operators.stages import add_columns
from paylens.session import stored
from paylens.sources.literals import literal_table
from paylens.sources.survey import normalise_nulls
from paylens.workloads.views import R_SQL, responses, table

_SENTINEL = """CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN 'na'
    WHEN 4 THEN 'null' ELSE o_orderpriority END"""


def scan_null_sentinels(spark, folder):
    texts = table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_SENTINEL} AS answer")
    return normalise_nulls(texts, ["answer"])


_SIZE = "CASE WHEN p_size > 45 THEN '501 + People' ELSE concat(p_size, ' People') END"


def clean_literals(spark, folder):
    sizes = table(spark, folder, "part").selectExpr("p_partkey AS id", f"{_SIZE} AS firm_size")
    return c.clean_literals(sizes, {"firm_size": [(" People", ""), ("501 +", "501+")]})


def remap_values(spark, folder):
    answers = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS answer")
    return c.remap_values(answers, "answer", {"1-URGENT": "> 40", "5-LOW": "31-40"})


def regex_repair(spark, folder):
    names = table(spark, folder, "part").selectExpr("p_partkey AS id", "p_name AS name")
    return c.regex_repair(names, ["name"], "r.d w.dget", "Réd Widgét")


def filter_not_equal_null_safe(spark, folder):
    return c.drop_equal(responses(spark, folder).select("id", "experience"), "experience", "5-LOW")


_DENIED = [5, 77, 1234, 9999, 14000]


def denylist_anti(spark, folder):
    denied = literal_table(spark, [(i,) for i in _DENIED], "id bigint")
    return c.drop_ids(responses(spark, folder).select("id", "salary"), denied)


def drop_bad_batch(spark, folder):
    rows = responses(spark, folder).selectExpr("id", "experience", "date_format(month, 'yyyy-MM') AS stamp", "location")
    return c.drop_bad_batch(rows, "experience", "stamp", "location", "1998-03", "NATION_3")


def parse_month_year(spark, folder):
    stamps = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "date_format(o_orderdate, \"MMM ''yy\") AS stamp")
    parsed = c.parse_month_year(stamps, "stamp", "year")
    return parsed.selectExpr("id", "date_format(stamp, 'yyyy-MM-dd') AS month", "CAST(year AS BIGINT) AS year")


def parse_thousands(spark, folder):
    texts = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "format_number(CAST(floor(o_totalprice) AS BIGINT), 0) AS amount"
    )
    return add_columns(texts, {"amount": t.parse_thousands("amount")})


_RATING = """CASE o_orderkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN '7.0' WHEN 3 THEN ' 5 '
    WHEN 4 THEN NULL ELSE CAST(1 + o_orderkey % 10 AS VARCHAR(20)) END"""


def coerce_numeric(spark, folder):
    ratings = table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_RATING} AS rating")
    return c.coerce_numeric(ratings, "rating").selectExpr("id", "CAST(rating AS BIGINT) AS rating")


def annualise(spark, folder):
    return c.annualise(responses(spark, folder), "salary", "unit", "work_status").select("id", "unit", "salary")


def min_threshold(spark, folder):
    return c.min_threshold(responses(spark, folder).select("id", "salary"), "salary", 10000)


def apply_corrections(spark, folder):
    fixes = literal_table(
        spark, [(7, 75600.0, "year"), (42, None, "month"), (4242, 27000.0, None)], "id bigint, salary double, unit string"
    )
    return c.apply_corrections(responses(spark, folder).select("id", "salary", "unit"), fixes)


_BONUS = """CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN NULL WHEN 2 THEN concat('$', o_orderkey, ',000')
    WHEN 3 THEN concat(o_orderkey, ' EUR') ELSE CAST(o_orderkey AS VARCHAR(20)) END"""


def strip_to_number(spark, folder):
    texts = table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_BONUS} AS bonus")
    return add_columns(texts, {"bonus": t.strip_to_number("bonus")})


def pattern_audit(spark, folder):
    texts = table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_BONUS} AS bonus")
    return c.pattern_audit(texts, "bonus", "[^0-9,]")


def fx_normalise(spark, folder):
    rows = responses(spark, folder).select("id", "salary", "unit")
    return c.fx_normalise(rows, "salary", "unit", {"CADyear": 0.72, "localcurrencyyear": 1.0})


def allowlist_split(spark, folder):
    kept, rejected = c.allowlist_split(responses(spark, folder), "unit", ["year", "hour"])
    counted = kept.groupBy("unit").count().selectExpr("'kept' AS side", "unit", "count AS n")
    return counted.unionByName(rejected.selectExpr("'rejected' AS side", "unit", "n"))


def quality_report(spark, folder):
    return c.quality_report(
        responses(spark, folder),
        {
            "missing_salary": "salary IS NULL",
            "missing_experience": "experience IS NULL",
            "missing_status": "work_status IS NULL",
            "low_salary": "salary < 10000",
        },
    )


def status_breakdown(spark, folder):
    return c.status_breakdown(responses(spark, folder), "work_status", ["Full-time", "Part-time", "Freelance"])


_YEARS = {"1-URGENT": 0.5, "2-HIGH": 6.5, "5-LOW": 35.5}


def bucket_midpoint(spark, folder):
    rows = responses(spark, folder).select("id", "experience")
    return c.bucket_midpoint(rows, "experience", _YEARS, "years")


_LINES = ["l_orderkey * 10 + l_linenumber AS id", "l_partkey % 50 AS kind", "l_suppkey", "l_returnflag", "l_linestatus"]
_LINES_SQL = f"l AS (SELECT {', '.join(_LINES)} FROM lineitem)"


def dedup_keep_first(spark, folder):
    return c.dedup_keep_first(table(spark, folder, "lineitem").selectExpr(*_LINES))


def dedup_landings(spark, folder):
    """Three landings, the last first: the state after all of them, and which responses the first landing had new."""
    lines = table(spark, folder, "lineitem").selectExpr(*_LINES)
    landings = [stored(landing_state(lines.where(f"id % 3 = {i}"))) for i in range(3)]
    state = stored(merge_states(landings[2], landings[1]))
    new = unseen(state, landings[0]).selectExpr("digest AS _digest")
    whole = merge_states(state, landings[0]).join(new, F.expr("digest = _digest"), "left")
    return whole.selectExpr("first_id AS id", "kind", "l_suppkey", "l_returnflag", "l_linestatus", "copies", "CAST(_digest IS NOT NULL AS BIGINT) AS new")


def duplicate_audit(spark, folder):
    return c.duplicate_audit(table(spark, folder, "lineitem").selectExpr(*_LINES))


def split_amount_unit(spark, folder):
    texts = table(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_PAY} AS pay")
    return texts.selectExpr("id", f"{t.digits_and_commas('pay')} AS amount", f"{t.letters_only('pay')} AS unit")


_PAY = "concat('$', o_orderkey, ',500 per ', CASE WHEN o_orderkey % 3 = 0 THEN 'hour' ELSE 'year' END)"

QUERIES = {
    "scan_null_sentinels": (
        scan_null_sentinels,
        f"SELECT o_orderkey AS id, nullif(nullif(nullif(nullif({_SENTINEL}, 'NA'), 'N/A'), ''), 'null') AS answer FROM orders",
    ),
    "clean_literals": (
        clean_literals,
        f"SELECT p_partkey AS id, replace(replace({_SIZE}, ' People', ''), '501 +', '501+') AS firm_size FROM part",
    ),
    "remap_values": (
        remap_values,
        "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN '> 40' WHEN '5-LOW' THEN '31-40' ELSE o_orderpriority END AS answer FROM orders",
    ),
    "regex_repair": (
        regex_repair,
        "SELECT p_partkey AS id, regexp_replace(p_name, 'r.d w.dget', 'Réd Widgét', 'g') AS name FROM part",
    ),
    "filter_not_equal_null_safe": (
        filter_not_equal_null_safe,
        f"WITH {R_SQL} SELECT id, experience FROM r WHERE experience IS DISTINCT FROM '5-LOW'",
    ),
    "denylist_anti": (
        denylist_anti,
        f"WITH {R_SQL} SELECT id, salary FROM r WHERE id NOT IN ({', '.join(map(str, _DENIED))})",
    ),
    "drop_bad_batch": (
        drop_bad_batch,
        f"""WITH {R_SQL}, s AS (SELECT id, experience, strftime(month, '%Y-%m') AS stamp, location FROM r)
        SELECT * FROM s WHERE NOT (experience IS NOT NULL AND stamp = '1998-03' AND location = 'NATION_3')""",
    ),
    "parse_month_year": (
        parse_month_year,
        """WITH s AS (SELECT o_orderkey AS id, strptime(strftime(o_orderdate, '%b %y'), '%b %y') AS d FROM orders)
        SELECT id, strftime(d, '%Y-%m-%d') AS month, year(d) AS year FROM s""",
    ),
    "parse_thousands": (
        parse_thousands,
        "SELECT o_orderkey AS id, CAST(replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '') AS BIGINT) AS amount FROM orders",
    ),
    "coerce_numeric": (
        coerce_numeric,
        f"""WITH s AS (SELECT o_orderkey AS id, try_cast({_RATING} AS DOUBLE) AS rating FROM orders)
        SELECT id, CAST(rating AS BIGINT) AS rating FROM s WHERE rating IS NOT NULL""",
    ),
    "annualise": (
        annualise,
        f"""WITH {R_SQL} SELECT id, unit,
        CASE WHEN unit = 'hour' AND work_status = 'Full-time' THEN salary * 2080 ELSE salary END AS salary FROM r""",
    ),
    "min_threshold": (min_threshold, f"WITH {R_SQL} SELECT id, salary FROM r WHERE salary >= 10000"),
    "apply_corrections": (
        apply_corrections,
        f"""WITH {R_SQL}, f(id, s, u) AS (VALUES (7, 75600.0::DOUBLE, 'year'), (42, NULL, 'month'), (4242, 27000.0::DOUBLE, NULL))
        SELECT r.id, coalesce(s, salary) AS salary, coalesce(u, unit) AS unit FROM r LEFT JOIN f ON r.id = f.id""",
    ),
    "strip_to_number": (
        strip_to_number,
        f"SELECT o_orderkey AS id, CAST(nullif(regexp_replace({_BONUS}, '[^0-9]', '', 'g'), '') AS DOUBLE) AS bonus FROM orders",
    ),
    "pattern_audit": (
        pattern_audit,
        f"SELECT * FROM (SELECT o_orderkey AS id, {_BONUS} AS bonus FROM orders) WHERE regexp_matches(bonus, '[^0-9,]')",
    ),
    "fx_normalise": (
        fx_normalise,
        f"""WITH {R_SQL} SELECT id, CASE WHEN unit = 'CADyear' THEN round_even(salary * 0.72::DOUBLE, 0) ELSE salary END AS salary,
        CASE WHEN unit IN ('CADyear', 'localcurrencyyear') THEN 'year' ELSE unit END AS unit FROM r""",
    ),
    "allowlist_split": (
        allowlist_split,
        f"""WITH {R_SQL} SELECT CASE WHEN unit IN ('year', 'hour') THEN 'kept' ELSE 'rejected' END AS side, unit,
        count(*) AS n FROM r GROUP BY 1, 2""",
    ),
    "quality_report": (
        quality_report,
        f"""WITH {R_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE salary IS NULL) AS missing_salary,
        count(*) FILTER (WHERE experience IS NULL) AS missing_experience,
        count(*) FILTER (WHERE work_status IS NULL) AS missing_status,
        count(*) FILTER (WHERE salary < 10000) AS low_salary FROM r""",
    ),
    "status_breakdown": (
        status_breakdown,
        f"""WITH {R_SQL} SELECT count(*) FILTER (WHERE work_status = 'Full-time') AS full_time,
        count(*) FILTER (WHERE work_status = 'Part-time') AS part_time,
        count(*) FILTER (WHERE work_status = 'Freelance') AS freelance,
        count(*) FILTER (WHERE work_status IS NULL) AS not_specified FROM r""",
    ),
    "bucket_midpoint": (
        bucket_midpoint,
        f"""WITH {R_SQL} SELECT id, experience, CAST(CASE experience WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 6.5
        WHEN '5-LOW' THEN 35.5 END AS DOUBLE) AS years FROM r""",
    ),
    "dedup_keep_first": (
        dedup_keep_first,
        f"WITH {_LINES_SQL} SELECT min(id) AS id, kind, l_suppkey, l_returnflag, l_linestatus FROM l GROUP BY ALL",
    ),
    "dedup_landings": (
        dedup_landings,
        f"""WITH {_LINES_SQL} SELECT min(id) AS id, kind, l_suppkey, l_returnflag, l_linestatus, count(*) AS copies,
        CAST(bool_and(id % 3 = 0) AS BIGINT) AS new FROM l GROUP BY ALL""",
    ),
    "duplicate_audit": (
        duplicate_audit,
        f"""WITH {_LINES_SQL}, d AS (SELECT kind, l_suppkey, l_returnflag, l_linestatus, count(*) AS copies FROM l
        GROUP BY ALL HAVING count(*) > 1) SELECT l.*, d.copies FROM l JOIN d USING (kind, l_suppkey, l_returnflag, l_linestatus)""",
    ),
    "split_amount_unit": (
        split_amount_unit,
        f"""SELECT o_orderkey AS id, regexp_replace({_PAY}, '[^0-9,]', '', 'g') AS amount,
        regexp_replace({_PAY}, '[^a-zA-Z]', '', 'g') AS unit FROM orders""",
    ),
}
