"""Composite equal-area conic projection and hexagon cells as SQL expressions.

Formulas: Snyder, Map Projections - A Working Manual, USGS PP 1395 (1987), section 14;
hexagon binning after Carr, Olsen and White (1992).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from paylens.functions.sql import lit


@dataclass(frozen=True)
class Region:
    name: str
    rotate: float
    center: tuple[float, float]
    parallels: tuple[float, float]
    zoom: float
    offset: tuple[float, float]
    clip: tuple[float, float, float, float]  # x0, y0, x1, y1
    inset: float


# The four map regions in order of precedence. Offsets and clip boxes are
# multiples of the map scale; the inset is in pixels. Degrees throughout.
REGIONS = [
    Region("lower48", 96, (-0.6, 38.7), (29.5, 45.5), 1.0, (0.0, 0.0), (-0.455, -0.238, 0.455, 0.238), 0.0),
    Region("alaska", 154, (-2, 58.5), (55, 65), 0.35, (-0.307, 0.201), (-0.425, 0.120, -0.214, 0.234), 1e-6),
    Region("hawaii", 157, (-3, 19.9), (8, 18), 1.0, (-0.205, 0.212), (-0.214, 0.166, -0.115, 0.234), 1e-6),
    Region("puerto_rico", 66, (0, 18), (8, 18), 1.0, (0.350, 0.224), (0.320, 0.204, 0.380, 0.234), 0.0),
]

MAP_WIDTH = 928
MAP_HEIGHT = 581
MAP_SCALE = 4 / 3 * MAP_WIDTH
MAP_CENTER = (MAP_WIDTH / 2, MAP_HEIGHT / 2)
HEX_RADIUS = 10.0


def cone(region: Region) -> tuple[float, float, float]:
    """n, C and rho0 of the conic projection."""
    s0, s1 = (math.sin(math.radians(p)) for p in region.parallels)
    n = (s0 + s1) / 2
    c = 1 + s0 * (2 * n - s0)
    return n, c, math.sqrt(c) / n


def raw_center(region: Region) -> tuple[float, float]:
    n, c, rho0 = cone(region)
    lam, phi = (math.radians(v) for v in region.center)
    rho = math.sqrt(c - 2 * n * math.sin(phi)) / n
    return rho * math.sin(n * lam), rho0 - rho * math.cos(n * lam)


def _wrap(angle: str) -> str:
    return f"({angle} - {lit(2 * math.pi)} * rint({angle} / {lit(2 * math.pi)}))"


# Each function below returns stages: dictionaries of columns to add one after the other. Later
# stages use the columns of earlier ones, so nothing is computed twice and all of it stays inside
# generated code.
Stages = list[dict[str, str]]


def project(
    lon: str, lat: str, out: str, scale: float = MAP_SCALE, translate: tuple[float, float] = MAP_CENTER
) -> Stages:
    """`out` = array of one struct(region, x, y), of the first region whose clip box holds the point;
    null for a point in none of them."""
    polar, planar, candidates = {}, {}, []
    for r in REGIONS:
        n, c, rho0 = cone(r)
        cx, cy = raw_center(r)
        k = scale * r.zoom
        ox, oy = (translate[i] + r.offset[i] * scale for i in (0, 1))
        t, rho, x, y = (f"_{part}_{r.name}" for part in ("t", "rho", "x", "y"))
        polar[t] = f"{_wrap(f'(radians({lon}) + {lit(math.radians(r.rotate))})')} * {lit(n)}"
        polar[rho] = f"sqrt({lit(c)} - {lit(2 * n)} * sin(radians({lat}))) / {lit(n)}"
        planar[x] = f"({rho} * sin({t}) - {lit(cx)}) * {lit(k)} + {lit(ox)}"
        planar[y] = f"{lit(oy)} - ({lit(rho0)} - {rho} * cos({t}) - {lit(cy)}) * {lit(k)}"
        x0, y0, x1, y1 = (translate[i % 2] + v * scale for i, v in enumerate(r.clip))
        candidates.append(
            f"WHEN {x} >= {lit(x0 + r.inset)} AND {x} <= {lit(x1 - r.inset)}"
            f" AND {y} >= {lit(y0 + r.inset)} AND {y} <= {lit(y1 - r.inset)}"
            f" THEN array(named_struct('region', {lit(r.name)}, 'x', {x}, 'y', {y}))"
        )
    return [polar, planar, {out: f"CASE {' '.join(candidates)} END"}]


def unproject(
    x: str, y: str, out: str, scale: float = MAP_SCALE, translate: tuple[float, float] = MAP_CENTER
) -> Stages:
    """`out` = struct(region, lon, lat) of a map point; outside the inset boxes the lower 48 apply."""
    u, v = f"(({x} - {lit(translate[0])}) / {lit(scale)})", f"(({y} - {lit(translate[1])}) / {lit(scale)})"
    flat, boxes = {}, []
    for r in REGIONS:
        n, c, rho0 = cone(r)
        cx, cy = raw_center(r)
        k = scale * r.zoom
        ox, oy = (translate[i] + r.offset[i] * scale for i in (0, 1))
        px, py = f"_px_{r.name}", f"_py_{r.name}"
        flat[px] = f"({x} - {lit(ox)}) / {lit(k)} + {lit(cx)}"
        flat[py] = f"{lit(rho0)} - (({lit(oy)} - {y}) / {lit(k)} + {lit(cy)})"
        lon = _wrap(f"(atan2({px}, {py}) / {lit(n)} - {lit(math.radians(r.rotate))})")
        lat = f"asin(({lit(c)} - ({px} * {px} + {py} * {py}) * {lit(n * n)}) / {lit(2 * n)})"
        point = f"named_struct('region', {lit(r.name)}, 'lon', degrees({lon}), 'lat', degrees({lat}))"
        if r is REGIONS[0]:
            mainland = point
        else:
            x0, y0, x1, y1 = (lit(b) for b in r.clip)
            boxes.append(f"WHEN {u} >= {x0} AND {u} < {x1} AND {v} >= {y0} AND {v} < {y1} THEN {point}")
    return [flat, {out: f"CASE {' '.join(boxes)} ELSE {mainland} END"}]


def hex_cell(x: str, y: str, out_i: str, out_j: str, radius: float = HEX_RADIUS) -> Stages:
    """Hexagon (i, j) that holds a map point."""
    dx, dy = 2 * radius * math.sin(math.pi / 3), 1.5 * radius
    # the nearest hexagon may sit in the neighbouring row, half a column to one side
    side = "CASE WHEN _du < 0 THEN -1 ELSE 1 END"
    step = "CASE WHEN _dv < 0 THEN -1 ELSE 1 END"
    shift = "CASE WHEN pmod(_hj, 2) = 1 THEN 1 ELSE -1 END"
    across, down = "(_du - _side / 2D)", "(_dv - _step)"
    return [
        {"_hv": f"{y} / {lit(dy)}", "_hj": f"floor({y} / {lit(dy)} + 0.5D)"},
        {"_hu": f"{x} / {lit(dx)} - pmod(_hj, 2) / 2D"},
        {"_hi": "floor(_hu + 0.5D)", "_du": "_hu - floor(_hu + 0.5D)", "_dv": "_hv - _hj"},
        {"_side": side, "_step": step, "_shift": shift},
        {
            "_nearer": "abs(_dv) * 3 > 1 AND _du * _du + _dv * _dv"
            f" > {across} * {across} + {down} * {down}"
        },
        {
            # never null for a point on the map; saying so spares a null check of all of the above
            # wherever the cell is a join or group key
            out_i: "coalesce(CASE WHEN _nearer THEN _hi + CAST((_side + _shift) / 2 AS BIGINT) ELSE _hi END, 0L)",
            out_j: "coalesce(CASE WHEN _nearer THEN _hj + _step ELSE _hj END, 0L)",
        },
    ]


def hex_center(i: str, j: str, radius: float = HEX_RADIUS) -> tuple[str, str]:
    dx, dy = 2 * radius * math.sin(math.pi / 3), 1.5 * radius
    return f"({i} + pmod({j}, 2) / 2D) * {lit(dx)}", f"{j} * {lit(dy)}"
