"""Cross-filtering, search and whole-table orders."""

from __future__ import annotations

import uuid
from functools import reduce

from paylens.operators import crossfilter as cross
from paylens.operators import facets as f
from paylens.operators.aggregates import category_rank
from paylens.operators.pages import page_of, store_ranked
from paylens.operators.ranking import global_rank, sort_key
from paylens.operators.ranking import rank_grid as grid
from paylens.operators.suggestions import build_index, suggest
from paylens.session import ensure_checkpoint_dir
from paylens.workloads.views import R_SQL, responses

_FACETS = ["firm_type", "experience", "gender", "location"]


def _shown(spark, folder):
    """Responses with null answers shown as N/A."""
    return f.fill_not_given(responses(spark, folder), ["experience", "work_status"])


SHOWN_SQL = f"""{R_SQL}, s AS (SELECT * REPLACE (coalesce(experience, 'N/A') AS experience,
    coalesce(work_status, 'N/A') AS work_status) FROM r)"""

_FILTERS = f.FilterSet(
    {
        "firm_type": f.membership("firm_type", ["BUILDING", "MACHINERY", "FURNITURE"]),
        "experience": f.membership("experience", ["1-URGENT", "N/A"]),
        "salary": f.value_range("salary", 50000.0, 400000.0, cap=500000.0),
        "location": f.text_search("location", "nation_1"),
    }
)
_FILTERS_SQL = {
    "firm_type": "firm_type IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
    "experience": "experience IN ('1-URGENT', 'N/A')",
    "salary": "salary BETWEEN 50000 AND 400000",
    "location": "contains(lower(location), 'nation_1')",
}


def _others(own):
    return " AND ".join(c for a, c in _FILTERS_SQL.items() if a != own)


def passes_filters(spark, folder):
    return f.flag_rows(_shown(spark, folder), _FILTERS).selectExpr("id", "CAST(passes AS BIGINT) AS passes")


def filter_membership(spark, folder):
    chosen = f.toggle(f.toggle(["1-URGENT"], "N/A"), "5-LOW")
    return _shown(spark, folder).where(f.membership("experience", chosen)).select("id", "experience")


def filter_range_open_top(spark, folder):
    rows = responses(spark, folder).select("id", "salary")
    closed = rows.where(f.value_range("salary", 100000.0, 400000.0, cap=450000.0)).selectExpr("'closed' AS top", "*")
    open_top = rows.where(f.value_range("salary", 100000.0, 449900.0, cap=450000.0)).selectExpr("'open' AS top", "*")
    return closed.unionByName(open_top)


_SEARCHES = ["", "any", "none", "NatION_2", "urg"]


def filter_text_search(spark, folder):
    rows = responses(spark, folder).selectExpr("id", "coalesce(experience, location) AS place", "experience")
    found = [
        rows.where(f.text_search(column, s)).selectExpr(f"'{s}' AS query", "id", f"{column} AS answer")
        for s, column in zip(_SEARCHES, ["experience", "experience", "experience", "place", "experience"])
    ]
    return reduce(lambda a, b: a.unionByName(b), found)


_NAMED = {
    "top": "salary >= 400000",
    "middle": "salary >= 150000 AND salary < 400000",
}


def filter_named(spark, folder):
    rows = responses(spark, folder).select("id", "salary")
    return rows.where(f.named_filter(_NAMED, "middle"))


def facet_counts(spark, folder):
    return f.facet_counts(_shown(spark, folder), _FILTERS, _FACETS)


def facet_order(spark, folder):
    counts = f.facet_counts(_shown(spark, folder), f.FilterSet(), ["experience"])
    return f.facet_order(counts, order=["5-LOW", "1-URGENT", "2-HIGH"]).selectExpr(
        "key", "count", f"{category_rank('key', ['5-LOW', '1-URGENT', '2-HIGH'])} AS place"
    )


def facet_histogram(spark, folder):
    return f.facet_histogram(_shown(spark, folder), _FILTERS, "salary", 0, 450000, 20)


_SALARY_BINS = cross.Bins(0, 450000, 20)


def cross_filter(spark, folder):
    """All facets and the histogram of one pass."""
    return cross.cross_counts(_shown(spark, folder), _FILTERS, _FACETS, {"salary": _SALARY_BINS})


def cross_filter_moved(spark, folder):
    """The same after the filter on experience has moved twice, from a cube of one pass."""
    cube = cross.moving_filter_cube(_shown(spark, folder), _FILTERS, "experience", _FACETS, {"salary": _SALARY_BINS})
    moved = [
        cross.move_filter(cube, "experience", f.membership("at", chosen)).selectExpr(f"'{name}' AS moved", "*")
        for name, chosen in {"first": ["2-HIGH"], "second": ["5-LOW", "N/A", "2-HIGH"]}.items()
    ]
    return moved[0].unionByName(moved[1])


_QUERIES = ["nation_1", "N", "io", "ion", "_2", "", "nation_17", "nothing", "ation_2"]


def suggest_index(spark, folder):
    """Suggestions for queries of any length from an index of one pass over the rows."""
    index = build_index(responses(spark, folder), "location", "id")
    found = [suggest(index, "location", s, 7).selectExpr(f"'{s}' AS query", "*") for s in _QUERIES]
    return reduce(lambda a, b: a.unionByName(b), found)


def suggest_values(spark, folder):
    return f.suggest_values(responses(spark, folder), "location", "nation_1", "id", 10)


def sort_by_category(spark, folder):
    rows = responses(spark, folder).select("id", "experience")
    return global_rank(rows, category_rank("experience", ["5-LOW", "1-URGENT", "2-HIGH"]), "id", out="place")


def listing_order(spark, folder):
    rows = responses(spark, folder).select("id", "satisfaction")
    key, ascending = sort_key("satisfaction", {}, "year")
    return global_rank(rows, key, "id", ascending, out="place")


def ranking_pages(spark, folder):
    """Three pages of a ranking from its stored copy."""
    path = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex}"
    rows = store_ranked(responses(spark, folder).select("id", "salary"), "salary", "id", path, ascending=False, block=1000)
    pages = [page_of(rows, p, 130, block=1000).selectExpr(f"{p}L AS page", "*") for p in (0, 7, 10)]
    return reduce(lambda a, b: a.unionByName(b), pages)


def rank_grid(spark, folder):
    ranked = global_rank(responses(spark, folder).select("id", "salary"), "salary", "id", ascending=False)
    return grid(ranked, per_row=125, cell=7.0, x_offset=23.5, y_offset=23.5)


def _cross_sql(experience=None):
    """All facets and the histogram, each under the other filters; the one on experience may be another."""
    changed = {**_FILTERS_SQL, **({"experience": experience} if experience else {})}

    def others(own):
        return " AND ".join(c for a, c in changed.items() if a != own)

    parts = [f"SELECT '{a}' AS facet, {a} AS key, count(*) FILTER (WHERE {others(a)}) AS count FROM s GROUP BY {a}" for a in _FACETS]
    parts.append(
        f"""SELECT 'salary' AS facet, CAST(b AS VARCHAR) AS key, count(salary) FILTER (WHERE {others('salary')}) AS count
        FROM range(0, 20) t(b) LEFT JOIN s ON salary BETWEEN 0 AND 450000 AND least(floor(salary / 22500), 19) = b GROUP BY b"""
    )
    return " UNION ALL ".join(parts)


def _facet_sql(facet):
    return f"""SELECT '{facet}' AS facet, {facet} AS key, count(*) FILTER (WHERE {_others(facet)}) AS count FROM s GROUP BY {facet}"""


QUERIES = {
    "passes_filters": (
        passes_filters,
        f"WITH {SHOWN_SQL} SELECT id, CAST({' AND '.join(_FILTERS_SQL.values())} AS BIGINT) AS passes FROM s",
    ),
    "filter_membership": (
        filter_membership,
        f"WITH {SHOWN_SQL} SELECT id, experience FROM s WHERE experience IN ('1-URGENT', 'N/A', '5-LOW')",
    ),
    "filter_range_open_top": (
        filter_range_open_top,
        f"""WITH {R_SQL} SELECT 'closed' AS top, id, salary FROM r WHERE salary BETWEEN 100000 AND 400000
        UNION ALL SELECT 'open', id, salary FROM r WHERE salary >= 100000""",
    ),
    "filter_text_search": (
        filter_text_search,
        f"""WITH {R_SQL} SELECT '' AS query, id, experience AS answer FROM r
        UNION ALL SELECT 'any', id, experience FROM r WHERE experience IS NOT NULL
        UNION ALL SELECT 'none', id, experience FROM r WHERE experience IS NULL
        UNION ALL SELECT 'NatION_2', id, coalesce(experience, location) FROM r
            WHERE contains(lower(coalesce(experience, location)), 'nation_2')
        UNION ALL SELECT 'urg', id, experience FROM r WHERE contains(lower(experience), 'urg')""",
    ),
    "filter_named": (
        filter_named,
        f"WITH {R_SQL} SELECT id, salary FROM r WHERE salary >= 150000 AND salary < 400000",
    ),
    "facet_counts": (
        facet_counts,
        f"WITH {SHOWN_SQL} " + " UNION ALL ".join(_facet_sql(x) for x in _FACETS),
    ),
    "facet_order": (
        facet_order,
        f"""WITH {SHOWN_SQL} SELECT experience AS key, count(*) AS count,
        CAST(CASE experience WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 END AS BIGINT) AS place FROM s GROUP BY 1""",
    ),
    "facet_histogram": (
        facet_histogram,
        f"""WITH {SHOWN_SQL} SELECT b AS bin, CAST(b * 22500 AS DOUBLE) AS left,
        (SELECT count(*) FROM s WHERE {_others('salary')} AND salary >= b * 22500
            AND (salary < (b + 1) * 22500 OR (b = 19 AND salary <= 450000))) AS count
        FROM (SELECT unnest(range(20)) AS b)""",
    ),
    "cross_filter": (cross_filter, f"WITH {SHOWN_SQL} {_cross_sql()}"),
    "cross_filter_moved": (
        cross_filter_moved,
        f"""WITH {SHOWN_SQL}, a AS ({_cross_sql("experience = '2-HIGH'")}), b AS ({_cross_sql("experience IN ('5-LOW', 'N/A', '2-HIGH')")})
        SELECT 'first' AS moved, * FROM a UNION ALL SELECT 'second' AS moved, * FROM b""",
    ),
    "suggest_index": (
        suggest_index,
        f"""WITH {R_SQL}, v AS (SELECT location, count(*) AS n, min(id) AS first_seen FROM r GROUP BY location)
        SELECT query, location, n, first_seen FROM v JOIN (SELECT unnest({_QUERIES}) AS query) ON contains(lower(location), lower(query))
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, first_seen) <= 7""",
    ),
    "suggest_values": (
        suggest_values,
        f"""WITH {R_SQL} SELECT location, count(*) AS n, min(id) AS first_seen FROM r WHERE contains(lower(location), 'nation_1')
        GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10""",
    ),
    "sort_by_category": (
        sort_by_category,
        f"""WITH {R_SQL} SELECT id, experience, row_number() OVER (ORDER BY CASE experience WHEN '5-LOW' THEN 1
        WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, id) - 1 AS place FROM r""",
    ),
    "listing_order": (
        listing_order,
        f"WITH {R_SQL} SELECT id, satisfaction, row_number() OVER (ORDER BY satisfaction DESC, id) - 1 AS place FROM r",
    ),
    "ranking_pages": (
        ranking_pages,
        f"""WITH {R_SQL}, k AS (SELECT id, salary, row_number() OVER (ORDER BY salary DESC, id) - 1 AS rank FROM r)
        SELECT rank // 130 AS page, id, salary, rank FROM k WHERE rank // 130 IN (0, 7, 10)""",
    ),
    "rank_grid": (
        rank_grid,
        f"""WITH {R_SQL}, k AS (SELECT id, salary, row_number() OVER (ORDER BY salary DESC, id) - 1 AS rank FROM r)
        SELECT id, salary, rank, rank % 125 AS grid_col, rank // 125 AS grid_row,
        CAST((rank % 125) * 7 + 23.5 AS DOUBLE) AS cx, CAST((rank // 125) * 7 + 23.5 AS DOUBLE) AS cy FROM k""",
    ),
}
