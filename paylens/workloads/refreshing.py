"""The whole batch job on responses made from orders."""

from __future__ import annotations

from paylens.functions.sql import q
from paylens.plans.refresh import refresh
from paylens.schema import RAW_COLUMNS
from paylens.workloads.extraction import PARTS_SQL, parts
from paylens.workloads.views import FILLED_SQL, IDX_SQL, INDEX_END, monthly_index, table

# The text of each raw column; a missing answer is written NA, as in a landed file.
_RAW = {
    "id": "CAST(k AS STRING)",
    "Job Satisfaction": "CASE WHEN k % 9 = 0 THEN '-' ELSE CAST(k % 10 + 1 AS STRING) END",
    "Salary": "concat(k, ',500')",
    "Salary Unit": "CASE k % 10 WHEN 1 THEN 'CADperyear' WHEN 2 THEN 'CHFperyear' WHEN 3 THEN 'perhour' ELSE 'peryear' END",
    "Location": "concat(n_name, ', US')",
    "Job Title": "c_name",
    "Firm Type": "segment",
    "Firm Size": "size",
    "Health Insurance": "CASE WHEN health <> '' THEN 'Yes' ELSE 'NA' END",
    "Overtime": "CASE WHEN overtime <> '' THEN overtime ELSE 'NA' END",
    "Vacation Days": "CAST(k % 30 AS STRING)",
    "Annual Bonus": "CASE WHEN k % 7 = 0 THEN 'NA' ELSE concat(k % 100, ',000') END",
    "Work Status": "CASE WHEN status <> '' THEN status ELSE 'NA' END",
    "Years of Experience": "CASE k % 5 WHEN 0 THEN '< 1' WHEN 1 THEN '40' WHEN 2 THEN '31- >40' ELSE '3-5' END",
    "Age": "CASE WHEN k % 23 = 0 THEN '103' WHEN k % 23 = 1 THEN 'NA' ELSE '26-30' END",
    "Gender": "gender",
    "Licensed": "CASE WHEN licence <> '' THEN licence ELSE 'No' END",
    "Undergraduate School": "concat('UG:', n_name)",
    "Graduate School": "'NA'",
    "Post-Graduate School": "'NA'",
    "Date": "date_format(o_orderdate, \"MMM ''yy\")",
}
_NAMES = {
    "id": "id", "Job Satisfaction": "satisfaction", "Salary": "salary", "Salary Unit": "unit", "Location": "location",
    "Firm Type": "firm_type", "Firm Size": "firm_size", "Annual Bonus": "bonus", "Work Status": "work_status",
    "Years of Experience": "experience", "Age": "age", "Gender": "gender", "Licensed": "licensed",
    "Undergraduate School": "college", "Year": "year", "Latitude": "lat", "Inflation Adjusted Salary": "real_salary",
}


def raw_responses(spark, folder):
    return parts(spark, folder).selectExpr(*[f"{_RAW[c]} AS {q(c)}" for c in RAW_COLUMNS])


def _places(spark, folder, below):
    return table(spark, folder, "nation").where(f"n_nationkey < {below}").selectExpr(
        "concat(n_name, ', US') AS Location", "CAST(25 + n_nationkey AS DOUBLE) AS Latitude",
        "CAST(-124 + 2 * n_nationkey AS DOUBLE) AS Longitude",
    )


def survey_refresh(spark, folder):
    result = refresh(
        raw_responses(spark, folder), _places(spark, folder, 20), _places(spark, folder, 24), monthly_index(spark, folder, INDEX_END)
    )
    whole = {"satisfaction", "year"}
    return result.clean.selectExpr(
        *[f"CAST({q(c)} AS BIGINT) AS {n}" if n in whole else f"{q(c)} AS {n}" for c, n in _NAMES.items()],
        "round(CPIAUCSL, 6) AS cpi",
    )


_SQL = f"""WITH {PARTS_SQL}, {IDX_SQL}, {FILLED_SQL},
places AS (SELECT n_name AS place, CAST(25 + n_nationkey AS DOUBLE) AS lat FROM nation WHERE n_nationkey < 24),
a AS (SELECT *, CASE k % 10 WHEN 1 THEN 'CADyear' WHEN 2 THEN 'CHFyear' WHEN 3 THEN 'hour' ELSE 'year' END AS u,
    k * 1000 + 500 AS amount, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM p
  WHERE k NOT IN (12734, 2653, 5573, 8747, 3616) AND k % 23 <> 0 AND k % 9 <> 0 AND status <> 'Part-time'),
b AS (SELECT *, CASE WHEN u = 'hour' AND status = 'Full-time' THEN amount * 2080 ELSE amount END AS yearly FROM a),
c AS (SELECT *, CAST(CASE WHEN u = 'CADyear' THEN round_even(yearly * 0.72::DOUBLE, 0) ELSE yearly END AS BIGINT) AS paid
  FROM b WHERE yearly >= 10000 AND u <> 'CHFyear'),
d AS (SELECT c.*, lat, coalesce(f.value, CASE WHEN m > latest.date THEN latest.value END) AS cpi, latest.value AS now
  FROM c JOIN places ON place = n_name LEFT JOIN filled f ON f.date = m CROSS JOIN latest),
e AS (SELECT *, CASE WHEN k = 17102 THEN 75600 ELSE paid END AS salary FROM d)
SELECT k AS id, k % 10 + 1 AS satisfaction, salary,
    CASE WHEN u = 'CADyear' OR k = 17102 THEN 'year' ELSE u END AS unit, n_name AS location, segment AS firm_type,
    replace(size, ' People', '') AS firm_size,
    CAST(CASE k WHEN 17102 THEN 5760 WHEN 4576 THEN 27000 WHEN 3825 THEN 2160 ELSE CASE WHEN k % 7 <> 0 THEN k % 100 * 1000 END END AS DOUBLE) AS bonus,
    nullif(status, '') AS work_status,
    CASE k % 5 WHEN 0 THEN '< 1' WHEN 1 THEN '> 40' WHEN 2 THEN '31-40' ELSE '3-5' END AS experience,
    CASE WHEN k % 23 <> 1 THEN '26-30' END AS age, replace(gender, 'Gender: ', '') AS gender,
    CASE WHEN licence <> '' THEN 'Yes' ELSE 'No' END AS licensed, n_name AS college, year(m) AS year, lat,
    round_even(CAST(salary AS DOUBLE) * (now / cpi), -2) AS real_salary, round(cpi, 6) AS cpi FROM e"""


def refresh_quality(spark, folder):
    """What the refresh finds missing, and what each of its steps drops."""
    return refresh(
        raw_responses(spark, folder), _places(spark, folder, 20), _places(spark, folder, 24), monthly_index(spark, folder, INDEX_END)
    ).report


_QUALITY_SQL = f"""WITH {PARTS_SQL}, {IDX_SQL}, {FILLED_SQL},
a AS (SELECT k, status, k % 9 = 0 AS ms, CASE k % 10 WHEN 1 THEN 'CADyear' WHEN 2 THEN 'CHFyear' WHEN 3 THEN 'hour' ELSE 'year' END AS u,
    n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 24) AS placed,
    f.value IS NOT NULL OR CAST(date_trunc('month', o_orderdate) AS DATE) > latest.date AS indexed
  FROM p LEFT JOIN filled f ON f.date = CAST(date_trunc('month', o_orderdate) AS DATE) CROSS JOIN latest
  WHERE k NOT IN (12734, 2653) AND k % 23 <> 0),
b AS (SELECT *, CASE WHEN ms THEN 'satisfaction' WHEN status = 'Part-time' THEN 'part_time'
    WHEN (k * 1000 + 500) * CASE WHEN u = 'hour' AND status = 'Full-time' THEN 2080 ELSE 1 END < 10000 THEN 'pay'
    WHEN NOT placed THEN 'place' WHEN k IN (5573, 8747, 3616) THEN 'ids' WHEN u = 'CHFyear' AND k <> 17102 THEN 'unit' ELSE '' END AS step FROM a)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing_salary, count(*) FILTER (ms) AS missing_satisfaction,
    count(*) FILTER (NOT placed) AS missing_coordinates, count(*) FILTER (NOT indexed) AS missing_index,
    {', '.join(f"count(*) FILTER (step = '{x}') AS dropped_{x}" for x in ('satisfaction', 'part_time', 'pay', 'place', 'ids', 'unit'))},
    count(*) FILTER (step = '') AS kept FROM b"""

QUERIES = {"survey_refresh": (survey_refresh, _SQL), "refresh_quality": (refresh_quality, _QUALITY_SQL)}
