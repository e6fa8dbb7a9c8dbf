"""Counts, means, medians, pivots and distributions."""

from __future__ import annotations

from functools import reduce

from paylens.operators import aggregates as a
from paylens.operators import distributions as d
from paylens.operators.heavy import heavy_topn
from paylens.operators.quantiles import group_median
from paylens.workloads.views import ADJUSTED_SQL, PRIORITIES, R_SQL, STATUSES, adjusted_responses, responses, table


def median_by_group(spark, folder):
    return group_median(responses(spark, folder), ["year", "firm_type"], "salary").selectExpr(
        "year", "firm_type", "round(median, 4) AS median"
    )


def median_by_year_filtered(spark, folder):
    rows = responses(spark, folder)
    one = a.median_where(rows, "firm_type", "BUILDING", "year", "salary").selectExpr("'BUILDING' AS chosen", "*")
    every = a.median_where(rows, "firm_type", "All", "year", "salary").selectExpr("'All' AS chosen", "*")
    return one.unionByName(every).selectExpr("chosen", "year", "round(median, 4) AS median")


def count_by_group(spark, folder):
    return a.count_by_group(responses(spark, folder), ["experience"])


def mean_by_group(spark, folder):
    return a.mean_by_group(responses(spark, folder), ["experience"], "satisfaction").selectExpr(
        "experience", "round(mean, 6) AS mean"
    )


def topn_values(spark, folder):
    return a.topn_values(responses(spark, folder), "location", 10, "id")


def topn_heavy(spark, folder):
    """Frequent values from a summary of 256 counters; ship dates are too flat for it and are counted in full."""
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS id", "l_returnflag AS a", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS b")
    found = [heavy_topn(lines, c, n, "id", 256).selectExpr(f"'{c}' AS column", f"{c} AS value", "n", "first_seen") for c, n in (("a", 2), ("b", 20))]
    return found[0].unionByName(found[1])


def _profile(spark, folder, column, feature):
    table = a.profile_by_attribute(
        responses(spark, folder), column, feature, "id", n=5, measure="salary", satisfaction="satisfaction",
        wide=("location",), key_ordered=("satisfaction",), orders={"experience": PRIORITIES},
    )
    return table.selectExpr(
        f"'{column}' AS attribute", f"'{feature}' AS feature", f"CAST({column} AS STRING) AS key",
        "round(CAST(value AS DOUBLE), 4) AS value",
    )


_PROFILES = [("location", "count"), ("location", "median"), ("location", "mean"), ("experience", "median"), ("satisfaction", "count")]


def profile_by_attribute(spark, folder):
    return reduce(lambda x, y: x.unionByName(y), [_profile(spark, folder, *p) for p in _PROFILES])


_TOP5 = "(SELECT location FROM r GROUP BY location ORDER BY count(*) DESC, min(id) LIMIT 5)"


def _profile_sql(column, feature):
    value = {"count": "count(*)", "median": "median(salary)", "mean": "avg(satisfaction)"}[feature]
    keep = f"location IN {_TOP5}" if column == "location" else f"{column} IS NOT NULL"
    return f"""SELECT '{column}' AS attribute, '{feature}' AS feature, CAST({column} AS VARCHAR) AS key,
        round(CAST({value} AS DOUBLE), 4) AS value FROM r WHERE {keep} GROUP BY {column}"""


def median_two_keys(spark, folder):
    return group_median(responses(spark, folder), ["experience", "gender"], "salary").selectExpr(
        "experience", "gender", "round(median, 4) AS median"
    )


def mean_count_two_keys(spark, folder):
    return a.mean_count_by_group(responses(spark, folder), ["experience", "gender"], "satisfaction").selectExpr(
        "experience", "gender", "round(mean, 6) AS mean", "n"
    )


def pivot_matrices(spark, folder):
    wide = a.pivot_matrices(responses(spark, folder), "firm_type", "experience", PRIORITIES, "satisfaction", "salary")
    rounded = [f"round(`{c}`, 4) AS `{c}`" if c[:5] in ("mean_", "media") else f"`{c}`" for c in wide.columns]
    return wide.selectExpr(*rounded)


def _matrices_sql():
    cells = []
    for p in PRIORITIES:
        at = f"FILTER (WHERE experience = '{p}')"
        cells += [f'round(avg(satisfaction) {at}, 4) AS "mean_{p}"', f'round(median(salary) {at}, 4) AS "median_{p}"',
                  f'count(satisfaction) {at} AS "count_{p}"']
    return f"WITH {R_SQL} SELECT firm_type, {', '.join(cells)} FROM r GROUP BY firm_type"


def pivot_long_wide(spark, folder):
    long = a.mean_by_group(responses(spark, folder), ["experience", "gender"], "satisfaction").selectExpr(
        "experience", "gender", "round(mean, 6) AS mean"
    )
    return a.pivot_long_wide(long, "experience", "gender", STATUSES, "mean")


def topn_median_trend(spark, folder):
    return a.topn_median_trend(responses(spark, folder), "location", "year", "salary", "id", 5).selectExpr(
        "location", "year", "round(median, 4) AS median", "round(overall_median, 4) AS overall_median"
    )


def count_band(spark, folder):
    points = a.mean_count_by_group(responses(spark, folder), ["experience", "gender"], "satisfaction")
    return a.count_band(points, "gender").selectExpr(
        "experience", "gender", "n", *[f"round({c}, 6) AS {c}" for c in ("mean", "thickness", "low", "high")]
    )


def distinct_options(spark, folder):
    return a.distinct_options(responses(spark, folder), "firm_type")


def measure_switch(spark, folder):
    rows = adjusted_responses(spark, folder)
    by_measure = [
        group_median(rows, ["firm_type"], m).selectExpr(f"'{m}' AS measure", "firm_type", "round(median, 4) AS median")
        for m in ("salary", "real_salary")
    ]
    return by_measure[0].unionByName(by_measure[1])


def boxplot_stats(spark, folder):
    box = d.boxplot_stats(responses(spark, folder), ["year"], "salary")
    return box.selectExpr("year", "n", *[f"round({c}, 4) AS {c}" for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def histogram_equal_width(spark, folder):
    pay = d.histogram_equal_width(responses(spark, folder), "salary", 100)
    values = d.histogram_equal_width(table(spark, folder, "events"), "value", 30, below=50)
    both = pay.selectExpr("'salary' AS measure", "*").unionByName(values.selectExpr("'value' AS measure", "*"))
    return both.selectExpr("measure", "bin", "round(left, 4) AS left", "round(right, 4) AS right", "n")


def _histogram_sql(measure, source, column, bins, keep):
    return f"""SELECT '{measure}' AS measure, b AS bin, round(lo + b * w, 4) AS left, round(lo + (b + 1) * w, 4) AS right,
        (SELECT count(*) FROM {source} WHERE {keep} AND {column} >= lo + b * w
            AND ({column} < lo + (b + 1) * w OR b = {bins - 1})) AS n
        FROM (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w FROM {source} WHERE {keep}),
        (SELECT unnest(range({bins})) AS b)"""


def density_curve(spark, folder):
    return d.density_curve(responses(spark, folder), "salary", 100).selectExpr(
        "point", "round(x, 4) AS x", "round(density, 6) AS density"
    )


QUERIES = {
    "median_by_group": (
        median_by_group,
        f"WITH {R_SQL} SELECT year, firm_type, round(median(salary), 4) AS median FROM r GROUP BY ALL",
    ),
    "median_by_year_filtered": (
        median_by_year_filtered,
        f"""WITH {R_SQL} SELECT 'BUILDING' AS chosen, year, round(median(salary), 4) AS median FROM r WHERE firm_type = 'BUILDING' GROUP BY year
        UNION ALL SELECT 'All', year, round(median(salary), 4) FROM r GROUP BY year""",
    ),
    "count_by_group": (
        count_by_group,
        f"WITH {R_SQL} SELECT experience, count(*) AS n FROM r WHERE experience IS NOT NULL GROUP BY 1",
    ),
    "mean_by_group": (
        mean_by_group,
        f"WITH {R_SQL} SELECT experience, round(avg(satisfaction), 6) AS mean FROM r WHERE experience IS NOT NULL GROUP BY 1",
    ),
    "topn_values": (
        topn_values,
        f"WITH {R_SQL} SELECT location, count(*) AS n, min(id) AS first_seen FROM r GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10",
    ),
    "topn_heavy": (
        topn_heavy,
        """WITH v AS (SELECT 'a' AS "column", l_returnflag AS value, l_orderkey * 8 + l_linenumber AS id FROM lineitem
            UNION ALL SELECT 'b', strftime(l_shipdate, '%Y-%m-%d'), l_orderkey * 8 + l_linenumber FROM lineitem)
        SELECT * FROM (SELECT "column", value, count(*) AS n, min(id) AS first_seen FROM v GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_seen) <= CASE "column" WHEN 'a' THEN 2 ELSE 20 END""",
    ),
    "profile_by_attribute": (
        profile_by_attribute,
        f"WITH {R_SQL} " + " UNION ALL ".join(_profile_sql(*p) for p in _PROFILES),
    ),
    "median_two_keys": (
        median_two_keys,
        f"WITH {R_SQL} SELECT experience, gender, round(median(salary), 4) AS median FROM r WHERE experience IS NOT NULL GROUP BY 1, 2",
    ),
    "mean_count_two_keys": (
        mean_count_two_keys,
        f"""WITH {R_SQL} SELECT experience, gender, round(avg(satisfaction), 6) AS mean, count(*) AS n
        FROM r WHERE experience IS NOT NULL GROUP BY 1, 2""",
    ),
    "pivot_matrices": (pivot_matrices, _matrices_sql()),
    "pivot_long_wide": (
        pivot_long_wide,
        f"WITH {R_SQL} SELECT experience, "
        + ", ".join(f"round(avg(satisfaction) FILTER (WHERE gender = '{s}'), 6) AS \"{s}\"" for s in STATUSES)
        + " FROM r WHERE experience IS NOT NULL GROUP BY 1",
    ),
    "topn_median_trend": (
        topn_median_trend,
        f"""WITH {R_SQL}, o AS (SELECT location, median(salary) AS m FROM r WHERE location IN {_TOP5} GROUP BY 1)
        SELECT r.location, year, round(median(salary), 4) AS median, round(any_value(m), 4) AS overall_median
        FROM r JOIN o ON r.location = o.location GROUP BY 1, 2""",
    ),
    "count_band": (
        count_band,
        f"""WITH {R_SQL}, p AS (SELECT experience, gender, avg(satisfaction) AS mean, count(*) AS n FROM r
        WHERE experience IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, n / max(n) OVER (PARTITION BY gender) * 5 AS thickness FROM p)
        SELECT experience, gender, n, round(mean, 6) AS mean, round(thickness, 6) AS thickness,
        round(mean - thickness / 2, 6) AS low, round(mean + thickness / 2, 6) AS high FROM t""",
    ),
    "distinct_options": (
        distinct_options,
        f"WITH {R_SQL} SELECT 'All' AS option UNION ALL SELECT DISTINCT firm_type FROM r",
    ),
    "measure_switch": (
        measure_switch,
        f"""WITH {ADJUSTED_SQL} SELECT 'salary' AS measure, firm_type, round(median(salary), 4) AS median FROM adjusted GROUP BY 2
        UNION ALL SELECT 'real_salary', firm_type, round(median(real_salary), 4) FROM adjusted GROUP BY 2""",
    ),
    "boxplot_stats": (
        boxplot_stats,
        f"""WITH {R_SQL}, b AS (SELECT year, quantile_cont(salary, 0.25) AS q1, median(salary) AS m, quantile_cont(salary, 0.75) AS q3
        FROM r GROUP BY year)
        SELECT r.year, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
        round(min(salary) FILTER (WHERE salary >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
        round(max(salary) FILTER (WHERE salary <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high
        FROM r JOIN b ON r.year = b.year GROUP BY r.year""",
    ),
    "histogram_equal_width": (
        histogram_equal_width,
        f"WITH {R_SQL} {_histogram_sql('salary', 'r', 'salary', 100, 'TRUE')}"
        f" UNION ALL {_histogram_sql('value', 'events', 'value', 30, 'value < 50')}",
    ),
    "density_curve": (
        density_curve,
        f"""WITH {R_SQL}, s AS (SELECT min(salary) AS lo, max(salary) AS hi, count(*) AS n,
        stddev_samp(salary) * power(count(*), -0.2) AS h FROM r), v AS (SELECT salary, count(*) AS c FROM r GROUP BY 1)
        SELECT g AS point, round(any_value(lo + g * (hi - lo) / 199), 4) AS x,
        round(sum(c * exp(-0.5 * power((lo + g * ((hi - lo) / 199) - salary) / h, 2)) / (h * sqrt(2 * pi())) * (hi - lo) / 100), 6) AS density
        FROM s, v, (SELECT unnest(range(200)) AS g) GROUP BY g""",
    ),
}
