"""Map projection and hexagon summaries."""

from __future__ import annotations

from paylens.operators import hexbins as h
from paylens.workloads.views import LAT, LON, R_SQL, responses, table


def project_points(spark, folder):
    points = table(spark, folder, "customer").selectExpr("c_custkey AS id", f"{LON} AS lon", f"{LAT} AS lat")
    return h.project_points(points, "lon", "lat").selectExpr("id", "region", "round(x, 6) AS x", "round(y, 6) AS y")


def _cells(spark, folder):
    return h.assign_cells(h.project_points(responses(spark, folder, places=True), "lon", "lat"))


def hexbin_counts(spark, folder):
    return h.hexbin_counts(_cells(spark, folder)).selectExpr(
        "cell_i", "cell_j", "n", "round(x, 6) AS x", "round(y, 6) AS y"
    )


_SHARES = {"share_f": "gender = 'F'", "share_full_time": "work_status = 'Full-time'"}
_MODES = {"experience": "experience", "location": "location", "firm_type": "firm", "gender": "gender"}


def _stats(spark, folder):
    return h.hexbin_stats(_cells(spark, folder), "salary", "satisfaction", _SHARES, _MODES, "id")


def hexbin_stats(spark, folder):
    stats = _stats(spark, folder)
    fractions = {"median": 4, "mean_satisfaction": 6, "share_f": 6, "share_full_time": 6}
    return stats.selectExpr(*[f"round({c}, {fractions[c]}) AS {c}" if c in fractions else c for c in stats.columns])


def hexbin_encode(spark, folder):
    bins = h.hexbin_counts(_cells(spark, folder)).where(f"n > {h.MIN_ROWS}")
    return h.hexbin_encode(bins, "n").selectExpr(
        "cell_i", "cell_j", "n", "round(color_value, 6) AS color_value", "round(hex_radius, 6) AS hex_radius"
    )


def hexbin_centres_lonlat(spark, folder):
    return h.hexbin_centres_lonlat(h.hexbin_counts(_cells(spark, folder))).selectExpr(
        "cell_i", "cell_j", "centre_region AS region", "round(lon, 6) AS lon", "round(lat, 6) AS lat"
    )


# --- the same in DuckDB, from the published formulas -------------------------------------------

_K = "(4.0::DOUBLE / 3 * 928)"
# name, rotation, centre, parallels, zoom, offset, clip box, inset
_REGION_ROWS = """regions(ord, region, rot, c0, c1, p0, p1, zoom, ox, oy, x0, y0, x1, y1, eps) AS (VALUES
    (1, 'lower48', 96.0::DOUBLE, -0.6::DOUBLE, 38.7::DOUBLE, 29.5::DOUBLE, 45.5::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
        -0.455::DOUBLE, -0.238::DOUBLE, 0.455::DOUBLE, 0.238::DOUBLE, 0.0::DOUBLE),
    (2, 'alaska', 154.0, -2.0, 58.5, 55.0, 65.0, 0.35, -0.307, 0.201, -0.425, 0.120, -0.214, 0.234, 0.000001),
    (3, 'hawaii', 157.0, -3.0, 19.9, 8.0, 18.0, 1.0, -0.205, 0.212, -0.214, 0.166, -0.115, 0.234, 0.000001),
    (4, 'puerto_rico', 66.0, 0.0, 18.0, 8.0, 18.0, 1.0, 0.350, 0.224, 0.320, 0.204, 0.380, 0.234, 0.0))"""
_CONES = f"""{_REGION_ROWS},
cones AS (SELECT *, (sin(radians(p0)) + sin(radians(p1))) / 2 AS n FROM regions),
cones2 AS (SELECT *, 1 + sin(radians(p0)) * (2 * n - sin(radians(p0))) AS c, {_K} * zoom AS k,
    464 + ox * {_K} AS tx, 290.5 + oy * {_K} AS ty FROM cones),
cones3 AS (SELECT *, sqrt(c) / n AS r0, sqrt(c - 2 * n * sin(radians(c1))) / n AS rc FROM cones2),
cones4 AS (SELECT *, rc * sin(n * radians(c0)) AS cx, r0 - rc * cos(n * radians(c0)) AS cy FROM cones3)"""


def _projected(source: str) -> str:
    """Rows of `source` (id, lon, lat, ...) with region, x, y as table `projected`."""
    return f"""{_CONES},
angles AS (SELECT s.id, c4.*, sqrt(c - 2 * n * sin(radians(lat))) / n AS rho,
    n * CASE WHEN lon + rot > 180 THEN radians(lon + rot - 360) WHEN lon + rot < -180 THEN radians(lon + rot + 360) ELSE radians(lon + rot) END AS t
  FROM {source} s CROSS JOIN cones4 c4),
planar AS (SELECT *, tx + k * (rho * sin(t) - cx) AS x, ty - k * (r0 - rho * cos(t) - cy) AS y FROM angles),
clipped AS (SELECT id, arg_min(region, ord) AS region, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM planar
  WHERE x BETWEEN 464 + x0 * {_K} + eps AND 464 + x1 * {_K} - eps AND y BETWEEN 290.5 + y0 * {_K} + eps AND 290.5 + y1 * {_K} - eps
  GROUP BY id),
projected AS (SELECT s.*, region, x, y FROM {source} s LEFT JOIN clipped USING (id))"""


_DX, _DY = "(20 * sin(pi() / 3))", "15.0::DOUBLE"
# the nearest of the candidate centres in the two rows around a point
_CELLS_SQL = f"""{R_SQL}, {_projected('r')},
near AS (SELECT id, x, y, j, i FROM (SELECT *, floor(x / {_DX} - (j % 2) / 2 + 0.5) AS i FROM
    (SELECT *, unnest([floor(y / {_DY}), floor(y / {_DY}) + 1]) AS j FROM projected WHERE x IS NOT NULL))),
best AS (SELECT id, arg_min(i, dist) AS cell_i, arg_min(j, dist) AS cell_j FROM (SELECT *,
    power(x / {_DX} - (j % 2) / 2 - i, 2) + power(y / {_DY} - j, 2) AS dist FROM near) GROUP BY id),
cells AS (SELECT p.*, CAST(cell_i AS BIGINT) AS cell_i, CAST(cell_j AS BIGINT) AS cell_j FROM projected p JOIN best USING (id))"""
_CENTRE = f"(cell_i + (cell_j % 2) / 2) * {_DX}", f"cell_j * {_DY}"


def _mode_sql(column: str, out: str) -> str:
    return f"""{out}_m AS (SELECT cell_i, cell_j, arg_min(v, ord) AS {out}_mode, max(c) AS {out}_mode_count FROM
    (SELECT cell_i, cell_j, {column} AS v, count(*) AS c, row_number() OVER (PARTITION BY cell_i, cell_j ORDER BY count(*) DESC, min(id)) AS ord
     FROM cells WHERE {column} IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


QUERIES = {
    "project_points": (
        project_points,
        f"""WITH pts AS (SELECT c_custkey AS id, {LON} AS lon, {LAT} AS lat FROM customer), {_projected('pts')}
        SELECT id, region, round(x, 6) AS x, round(y, 6) AS y FROM projected""",
    ),
    "hexbin_counts": (
        hexbin_counts,
        f"""WITH {_CELLS_SQL} SELECT cell_i, cell_j, count(*) AS n, round({_CENTRE[0]}, 6) AS x, round({_CENTRE[1]}, 6) AS y
        FROM cells GROUP BY cell_i, cell_j""",
    ),
    "hexbin_stats": (
        hexbin_stats,
        f"""WITH {_CELLS_SQL}, {', '.join(_mode_sql(c, o) for c, o in _MODES.items())},
        b AS (SELECT cell_i, cell_j, count(*) AS n, round(avg(satisfaction), 6) AS mean_satisfaction,
            round(count(*) FILTER (WHERE gender = 'F') / count(*), 6) AS share_f,
            round(count(*) FILTER (WHERE work_status = 'Full-time') / count(*), 6) AS share_full_time,
            round(median(salary), 4) AS median FROM cells GROUP BY 1, 2 HAVING count(*) > 5)
        SELECT b.*, {', '.join(f'{o}_mode, coalesce({o}_mode_count, 0) AS {o}_mode_count' for o in _MODES.values())}
        FROM b {' '.join(f'LEFT JOIN {o}_m USING (cell_i, cell_j)' for o in _MODES.values())}""",
    ),
    "hexbin_encode": (
        hexbin_encode,
        f"""WITH {_CELLS_SQL}, b AS (SELECT cell_i, cell_j, count(*) AS n FROM cells GROUP BY 1, 2 HAVING count(*) > 5),
        e AS (SELECT min(n) AS lo, max(n) AS hi FROM b)
        SELECT cell_i, cell_j, n, round(CASE WHEN hi = lo THEN 0 ELSE (n - lo) / (hi - lo) END, 6) AS color_value,
        round(10 * (0.3 + ((CASE WHEN hi > 2000 THEN 2 ELSE 1.1 END) - 0.3) *
            CASE WHEN hi = lo THEN 0.5 ELSE (sqrt(n) - sqrt(lo)) / (sqrt(hi) - sqrt(lo)) END), 6) AS hex_radius FROM b, e""",
    ),
    "hexbin_centres_lonlat": (
        hexbin_centres_lonlat,
        f"""WITH {_CELLS_SQL}, m AS (SELECT DISTINCT cell_i, cell_j, {_CENTRE[0]} AS mx, {_CENTRE[1]} AS my FROM cells),
        w AS (SELECT *, CASE WHEN v >= 0.120 AND v < 0.234 AND u >= -0.425 AND u < -0.214 THEN 'alaska'
            WHEN v >= 0.166 AND v < 0.234 AND u >= -0.214 AND u < -0.115 THEN 'hawaii'
            WHEN v >= 0.204 AND v < 0.234 AND u >= 0.320 AND u < 0.380 THEN 'puerto_rico' ELSE 'lower48' END AS region
          FROM (SELECT *, (mx - 464) / {_K} AS u, (my - 290.5) / {_K} AS v FROM m)),
        q AS (SELECT w.*, c4.* EXCLUDE (region), (mx - tx) / k + cx AS px, r0 - ((ty - my) / k + cy) AS py FROM w JOIN cones4 c4 USING (region))
        SELECT cell_i, cell_j, region, round(CASE WHEN degrees(atan2(px, py) / n) - rot < -180 THEN degrees(atan2(px, py) / n) - rot + 360
            ELSE degrees(atan2(px, py) / n) - rot END, 6) AS lon,
        round(degrees(asin((c - (px * px + py * py) * n * n) / (2 * n))), 6) AS lat FROM q""",
    ),
}
