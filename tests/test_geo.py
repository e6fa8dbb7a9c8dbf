"""Projection, hexagons and their summaries."""

import math
import random
from collections import Counter, defaultdict
from statistics import median

import pytest

from paylens.operators import hexbins as h
from paylens.functions.geo import HEX_RADIUS

# place, lon, lat, region, x, y, hexagon, hexagon centre
GOLDEN = [
    ("New York", -74.006, 40.7128, "lower48", 827.7939, 205.5433, (48, 14), (831.3844, 210)),
    ("Chicago", -87.6298, 41.8781, "lower48", 607.4542, 215.4151, (35, 14), (606.2178, 210)),
    ("Los Angeles", -118.2437, 34.0522, "lower48", 82.6273, 345.8173, (4, 23), (77.9423, 345)),
    ("Anchorage", -149.9003, 61.2181, "alaska", 106.8651, 518.2435, (6, 35), (112.5833, 525)),
    ("Honolulu", -157.8583, 21.3069, "hawaii", 254.0911, 522.9191, (14, 35), (251.1474, 525)),
    ("San Juan", -66.1057, 18.4655, "puerto_rico", 894.8999, 557.6133, (51, 37), (892.0062, 555)),
    ("Barrigada, GU", 144.7997, 13.4686, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def places(spark):
    return h.project_points(spark.createDataFrame([g[:3] for g in GOLDEN], "place string, lon double, lat double"), "lon", "lat")


def test_golden_points(places):
    got = {r["place"]: r for r in places.collect()}
    for place, _, _, region, x, y, _, _ in GOLDEN:
        assert got[place]["region"] == region
        if region:
            assert (got[place]["x"], got[place]["y"]) == pytest.approx((x, y), abs=1e-3)
        else:
            assert got[place]["x"] is None


def test_golden_cells(places):
    got = {r["place"]: (r["cell_i"], r["cell_j"]) for r in h.assign_cells(places).collect()}
    assert got == {g[0]: g[6] for g in GOLDEN if g[6]}
    centres = {(r["cell_i"], r["cell_j"]): (r["x"], r["y"]) for r in h.hexbin_counts(h.assign_cells(places)).collect()}
    for g in GOLDEN[:-1]:
        assert centres[g[6]] == pytest.approx(g[7], abs=1e-3)


def test_missing_coordinates_are_off_the_map(spark):
    df = spark.createDataFrame([(1, None, 40.0), (2, -90.0, None)], "id int, lon double, lat double")
    out = h.project_points(df, "lon", "lat")
    assert [(r["id"], r["x"]) for r in out.orderBy("id").collect()] == [(1, None), (2, None)]
    assert h.assign_cells(out).count() == 0


def test_points_land_in_the_nearest_hexagon(spark):
    r = random.Random(5)
    points = [(i, r.uniform(0, 928), r.uniform(0, 581)) for i in range(3000)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    cells = h.assign_cells(df).select("id", "cell_i", "cell_j").collect()
    dx, dy = 2 * HEX_RADIUS * math.sin(math.pi / 3), 1.5 * HEX_RADIUS

    def distance(p, i, j):
        return math.hypot(p[1] - (i + (j & 1) / 2) * dx, p[2] - j * dy)

    for cell in cells:
        p, i, j = points[cell["id"]], cell["cell_i"], cell["cell_j"]
        around = min(distance(p, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1))
        assert distance(p, i, j) <= around * 1.2


def test_counts_add_up_to_the_points_on_the_map(spark):
    df = spark.range(2000).selectExpr("-180 + id * 7919 % 36000 / 100 AS lon", "10 + id * 104729 % 6000 / 100 AS lat")
    projected = h.project_points(df, "lon", "lat")
    on_map = projected.where("region IS NOT NULL").count()
    assert 0 < on_map < 2000
    assert h.hexbin_counts(h.assign_cells(projected)).selectExpr("sum(n)").collect()[0][0] == on_map


def test_centre_goes_back_to_the_map(places):
    cells = h.hexbin_centres_lonlat(h.hexbin_counts(h.assign_cells(places)))
    again = h.project_points(cells.select("cell_i", "cell_j", "lon", "lat", "centre_region", "x", "y").withColumnsRenamed({"x": "x0", "y": "y0"}), "lon", "lat")
    for r in again.collect():
        assert (r["region"], r["x"], r["y"]) == (r["centre_region"], pytest.approx(r["x0"]), pytest.approx(r["y0"]))


def test_stats_against_plain_python(spark):
    r = random.Random(11)
    cells = [(0, 0), (1, 0), (2, 5)]
    data = []
    for seq in range(400):
        i, j = cells[0] if seq % 3 else r.choice(cells[1:])
        data.append((seq, i, j, r.choice([10.0, 20.0, 35.0, None]), r.randrange(1, 11), r.choice(["F", "M", None]), r.choice(["a", "b", "c", None])))
    data += [(1000 + k, 9, 9, 1.0, 5, "F", None) for k in range(6)]
    data += [(2000 + k, 8, 8, 1.0, 5, "F", "x") for k in range(5)]
    df = spark.createDataFrame(data, "seq int, cell_i bigint, cell_j bigint, pay double, sat int, gender string, school string")
    got = {
        (x["cell_i"], x["cell_j"]): x
        for x in h.hexbin_stats(df, "pay", "sat", {"female": "gender = 'F'"}, {"school": "school", "gender": "gender"}, "seq").collect()
    }
    groups = defaultdict(list)
    for d in data:
        groups[(d[1], d[2])].append(d)
    assert set(got) == {k for k, v in groups.items() if len(v) > 5}
    for k, x in got.items():
        g = groups[k]
        assert x["n"] == len(g)
        assert x["median"] == median(d[3] for d in g if d[3] is not None)
        assert x["mean_satisfaction"] == pytest.approx(sum(d[4] for d in g) / len(g))
        assert x["female"] == pytest.approx(sum(d[5] == "F" for d in g) / len(g))
        counts = Counter(d[6] for d in g if d[6] is not None)
        top = counts.most_common(1)[0] if counts else (None, 0)
        assert (x["school_mode"], x["school_mode_count"]) == top


def test_mode_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([(5, 1, "z"), (2, 1, "b"), (3, 1, "a"), (4, 1, "a"), (6, 1, "b")], "seq int, k int, v string")
    assert h.modes(df, ["k"], {"v": "v"}, "seq").collect()[0].asDict() == {"k": 1, "v_mode": "b", "v_mode_count": 2}


@pytest.mark.parametrize("counts, largest", [([6, 50, 2001], 20.0), ([6, 50, 2000], 11.0)])
def test_encoding(spark, counts, largest):
    df = spark.createDataFrame([(i, 0, n, n / 10) for i, n in enumerate(counts)], "cell_i bigint, cell_j bigint, n bigint, share double")
    got = h.hexbin_encode(df, "share").orderBy("cell_i").collect()
    assert [got[0]["color_value"], got[-1]["color_value"]] == [0.0, 1.0]
    assert [got[0]["hex_radius"], got[-1]["hex_radius"]] == pytest.approx([3.0, largest])
    other = h.hexbin_encode(df, "n", "share").orderBy("cell_i").collect()
    assert [other[0]["hex_radius"], other[-1]["hex_radius"]] == pytest.approx([1.0, 11.0])
    flat = h.hexbin_encode(df.limit(1), "share").collect()[0]
    assert (flat["color_value"], flat["hex_radius"]) == (0.0, pytest.approx(7.0))


def test_hexagons_coloured_by_category(spark):
    df = spark.createDataFrame([(0, 0, 4, "Boutique"), (0, 1, 9, None)], "cell_i int, cell_j int, n bigint, firm_mode string")
    got = h.hexbin_encode(df, "firm_mode").orderBy("cell_j").collect()
    assert [r["color_value"] for r in got] == ["Boutique", None] and got[0]["hex_radius"] < got[1]["hex_radius"]
