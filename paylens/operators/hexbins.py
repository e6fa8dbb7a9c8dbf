"""Hexagon summaries of projected responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.geo import HEX_RADIUS, hex_cell, hex_center, project, unproject
from paylens.functions.sql import lit, q
from paylens.operators.quantiles import group_median
from paylens.operators.stages import add_columns, add_staged

CELL = ["cell_i", "cell_j"]

# Fixed value: hexagons with this many rows or fewer are left out.
MIN_ROWS = 5


def project_points(df: DataFrame, lon: str = "Longitude", lat: str = "Latitude") -> DataFrame:
    """Add region, x and y of the composite map; null outside it.

    The point comes out of a generator, so a later filter on it stays above the projection instead
    of being pushed below as a second copy of all its trigonometry.
    """
    names = [q(c) for c in df.columns]
    point = add_staged(df, project(q(lon), q(lat), "_point"), {"_point": "_point"})
    return point.selectExpr(*names, "inline_outer(_point) AS (region, x, y)")


def assign_cells(projected: DataFrame, radius: float = HEX_RADIUS) -> DataFrame:
    """Add the hexagon of each point; points off the map are left out."""
    on_map = projected.where("x IS NOT NULL")
    return add_staged(on_map, hex_cell("x", "y", "_i", "_j", radius), {"cell_i": "_i", "cell_j": "_j"})


def hexbin_counts(cells: DataFrame, radius: float = HEX_RADIUS) -> DataFrame:
    """Rows per hexagon, with its centre on the map."""
    x, y = hex_center("cell_i", "cell_j", radius)
    return add_columns(cells.groupBy(*CELL).agg(F.expr("count(*) AS n")), {"x": x, "y": y})


def modes(df: DataFrame, keys: Sequence[str], columns: dict[str, str], seq: str) -> DataFrame:
    """Most frequent non-null value of several columns per group, with its count.

    Equal counts go to the value seen first. `columns` maps columns to output names. All columns
    come from one scan; rows shrink to one per (group, column, value) before the shuffle.
    """
    names = [q(k) for k in keys]
    entries = ", ".join(
        f"named_struct('attr', {lit(out)}, 'val', CAST({q(c)} AS STRING))" for c, out in columns.items()
    )
    best = (
        df.selectExpr(*names, f"{q(seq)} AS _seq", f"inline(array({entries}))")
        .where("val IS NOT NULL")
        .groupBy(*names, "attr", "val")
        .agg(F.expr("count(*) AS cnt"), F.expr("min(_seq) AS first_seen"))
        .groupBy(*names, "attr")
        .agg(F.expr("max_by(named_struct('val', val, 'cnt', cnt), named_struct('c', cnt, 's', -first_seen)) AS top"))
    )

    def pick(out: str, part: str) -> str:
        return f"max(CASE WHEN attr = {lit(out)} THEN top.{part} END)"

    # at most one row per column and group comes in here
    return best.groupBy(*names).agg(
        *[F.expr(f"{pick(o, 'val')} AS {q(o + '_mode')}") for o in columns.values()],
        *[F.expr(f"coalesce({pick(o, 'cnt')}, 0L) AS {q(o + '_mode_count')}") for o in columns.values()],
    )


def hexbin_stats(
    cells: DataFrame,
    measure: str,
    satisfaction: str,
    shares: dict[str, str],
    mode_columns: dict[str, str],
    seq: str,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Per hexagon: rows, median of the measure, mean satisfaction, shares and modes.

    A share counts the rows that meet a condition and divides by all rows of the hexagon, unknown
    answers included. Only hexagons with more than `min_rows` rows are kept. Two scans: one for the medians, one for
    all else, in which the rows as such are one more attribute beside those with a mode.
    """
    entries = ", ".join(
        ["named_struct('attr', '', 'val', '')"]
        + [f"named_struct('attr', {lit(out)}, 'val', CAST({q(c)} AS STRING))" for c, out in mode_columns.items()]
    )
    flags = [f"CAST(coalesce({c}, FALSE) AS INT) AS _flag_{i}" for i, c in enumerate(shares.values())]
    hits = [F.expr(f"sum(_flag_{i}) AS _flag_{i}") for i in range(len(shares))]
    counted = (
        cells.selectExpr(*CELL, f"{q(seq)} AS _seq", f"CAST({q(satisfaction)} AS DOUBLE) AS _sat", *flags, f"inline(array({entries}))")
        .where("val IS NOT NULL")
        .groupBy(*CELL, "attr", "val")
        .agg(F.expr("count(*) AS cnt"), F.expr("min(_seq) AS first_seen"), F.expr("sum(_sat) AS _sat"), F.expr("count(_sat) AS _sats"), *hits)
        .groupBy(*CELL, "attr")
        .agg(
            F.expr("max_by(named_struct('val', val, 'cnt', cnt), named_struct('c', cnt, 's', -first_seen)) AS top"),
            *[F.expr(f"max({c}) AS {c}") for c in ("_sat", "_sats", *[f"_flag_{i}" for i in range(len(shares))])],
        )
    )

    def pick(attr: str, part: str) -> str:
        return f"max(CASE WHEN attr = {lit(attr)} THEN {part} END)"

    # at most one row per attribute and hexagon comes in here
    plain = counted.groupBy(*CELL).agg(
        F.expr(f"{pick('', 'top.cnt')} AS n"),
        F.expr(f"{pick('', '_sat')} / {pick('', 'nullif(_sats, 0)')} AS mean_satisfaction"),
        *[F.expr(f"{pick('', f'_flag_{i}')} / {pick('', 'top.cnt')} AS {q(name)}") for i, name in enumerate(shares)],
        *[F.expr(f"{pick(o, 'top.val')} AS {q(o + '_mode')}") for o in mode_columns.values()],
        *[F.expr(f"coalesce({pick(o, 'top.cnt')}, 0L) AS {q(o + '_mode_count')}") for o in mode_columns.values()],
    )
    order = ["n", "mean_satisfaction", *shares]
    tops = [f"{o}_mode" for o in mode_columns.values()] + [f"{o}_mode_count" for o in mode_columns.values()]
    medians = group_median(cells, CELL, measure, "median")
    return plain.where(f"n > {min_rows}").join(medians, CELL, "left").select(*CELL, *[q(c) for c in order], "median", *[q(c) for c in tops])


def hexbin_encode(bins: DataFrame, color_by: str, size_by: str = "n", radius: float = HEX_RADIUS) -> DataFrame:
    """Colour position between 0 and 1 and drawn radius of each hexagon.

    Colour is linear between the smallest and the largest value, and for a text the category itself; the radius
    follows the square root. The extremes are one row, read as a scalar, so the hexagons stay where they are.
    """
    by_name = dict(bins.dtypes)[color_by] == "string"
    color, size = "0D" if by_name else f"CAST({q(color_by)} AS DOUBLE)", f"CAST({q(size_by)} AS DOUBLE)"
    extremes = f"named_struct('c0', min({color}), 'c1', max({color}), 's0', min({size}), 's1', max({size})) AS e"
    place = f"CASE WHEN _e.s1 = _e.s0 THEN 0.5D ELSE (sqrt({size}) - sqrt(_e.s0)) / (sqrt(_e.s1) - sqrt(_e.s0)) END"
    # Ranges of the drawn radius as parts of the hexagon radius
    if size_by == "n":
        smallest, largest = "0.3D", "CASE WHEN _e.s1 > 2000 THEN 2.0D ELSE 1.1D END"
    else:
        smallest, largest = "0.1D", "1.1D"
    return add_columns(
        bins.withColumn("_e", bins.selectExpr(extremes).scalar()),
        {
            "color_value": q(color_by) if by_name else f"CASE WHEN _e.c1 = _e.c0 THEN 0D ELSE ({color} - _e.c0) / (_e.c1 - _e.c0) END",
            "hex_radius": f"({smallest} + ({largest} - {smallest}) * {place}) * {lit(radius)}",
        },
    ).drop("_e")


def hexbin_centres_lonlat(bins: DataFrame, radius: float = HEX_RADIUS) -> DataFrame:
    """Add longitude and latitude of each hexagon centre."""
    x, y = hex_center("cell_i", "cell_j", radius)
    stages = [{"_cx": x, "_cy": y}, *unproject("_cx", "_cy", "_centre")]
    return add_staged(
        bins, stages, {"centre_region": "_centre.region", "lon": "_centre.lon", "lat": "_centre.lat"}
    )
