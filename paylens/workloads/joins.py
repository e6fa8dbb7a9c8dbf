"""Lookups: coordinates, gazetteer, cache, top-N."""

from __future__ import annotations

from paylens.operators import joins as j
from paylens.operators.aggregates import topn_values
from paylens.sources.sinks import new_cache_rows
from paylens.workloads.views import R_SQL, responses, table


def _places(spark, folder, below):
    nation = table(spark, folder, "nation").where(f"n_nationkey < {below}")
    return nation.selectExpr(
        "n_name AS location", "CAST(25 + n_nationkey AS DOUBLE) AS lat", "CAST(-124 + 2 * n_nationkey AS DOUBLE) AS lon"
    )


# The cache knows 20 places, the gazetteer 24; one place stays unknown.
def _cache(spark, folder):
    return _places(spark, folder, 20)


def _gazetteer(spark, folder):
    return _places(spark, folder, 24)


_PLACES_SQL = """places AS (SELECT n_name AS location, n_nationkey AS k, CAST(25 + n_nationkey AS DOUBLE) AS lat,
    CAST(-124 + 2 * n_nationkey AS DOUBLE) AS lon FROM nation)"""


def enrich_location(spark, folder):
    rows = responses(spark, folder).select("id", "location")
    return j.enrich_location(rows, _cache(spark, folder), "location")


def unresolved_keys(spark, folder):
    return j.unresolved_keys(responses(spark, folder), _cache(spark, folder), "location")


def fill_from_gazetteer(spark, folder):
    rows = enrich_location(spark, folder)
    found, missing = j.fill_from_gazetteer(rows, _gazetteer(spark, folder), "location", ("lat", "lon"))
    return found.selectExpr("*", "'found' AS side").unionByName(missing.selectExpr("*", "'missing' AS side"))


def cache_upsert(spark, folder):
    cache = _cache(spark, folder)
    wanted = j.unresolved_keys(responses(spark, folder), cache, "location")
    resolved = j.enrich_location(wanted, _gazetteer(spark, folder), "location")
    new = new_cache_rows(resolved, cache, "location")
    return cache.selectExpr("*", "'cached' AS origin").unionByName(new.selectExpr("*", "'new' AS origin"))


def topn_semi(spark, folder):
    rows = responses(spark, folder).select("id", "location", "salary")
    return j.topn_semi(rows, topn_values(rows, "location", 10, "id"), "location")


def lookup_large(spark, folder):
    """Customers as a dimension too large to broadcast: the gate is lowered to a hundred rows."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "o_custkey AS c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return j.lookup_join(rows, customers, "c_custkey", max_rows=100)


QUERIES = {
    "lookup_large": (
        lookup_large,
        "SELECT o_orderkey AS id, o_custkey AS c_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    ),
    "enrich_location": (
        enrich_location,
        f"WITH {R_SQL}, {_PLACES_SQL} SELECT id, r.location, p.lat, p.lon FROM r LEFT JOIN places p ON r.location = p.location AND k < 20",
    ),
    "unresolved_keys": (
        unresolved_keys,
        f"WITH {R_SQL}, {_PLACES_SQL} SELECT DISTINCT location FROM r WHERE location NOT IN (SELECT location FROM places WHERE k < 20)",
    ),
    "fill_from_gazetteer": (
        fill_from_gazetteer,
        f"""WITH {R_SQL}, {_PLACES_SQL} SELECT id, r.location, p.lat, p.lon,
        CASE WHEN p.lat IS NULL THEN 'missing' ELSE 'found' END AS side
        FROM r LEFT JOIN places p ON r.location = p.location AND k < 24""",
    ),
    "cache_upsert": (
        cache_upsert,
        f"""WITH {R_SQL}, {_PLACES_SQL} SELECT location, lat, lon, 'cached' AS origin FROM places WHERE k < 20
        UNION ALL SELECT location, lat, lon, 'new' FROM places WHERE k BETWEEN 20 AND 23 AND location IN (SELECT location FROM r)""",
    ),
    "topn_semi": (
        topn_semi,
        f"""WITH {R_SQL} SELECT id, location, salary FROM r WHERE location IN
        (SELECT location FROM r GROUP BY location ORDER BY count(*) DESC, min(id) LIMIT 10)""",
    ),
}
