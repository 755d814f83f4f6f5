"""Zones by outlines against ray casting over all edges."""

import random

from pyspark.sql import functions as F

from siftwork.operators.zones import zone_cells, zone_in_outlines, outline_edges

OUTLINES = "zone string, points array<struct<lon:double,lat:double>>"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def expected(places, zones):
    box = lambda rings: (max(x for r in rings for x, _ in r) - min(x for r in rings for x, _ in r)) * (max(y for r in rings for _, y in r) - min(y for r in rings for _, y in r))
    out = {}
    for lat, lon in places:
        hits = [(box(rings), z) for z, rings in zones.items() if any(inside(x, lat, rings) for x in (lon, lon + 360, lon - 360))]
        out[lat, lon] = min(hits)[1] if hits else "none"
    return out


def test_equals_ray_casting(spark):
    r = random.Random(9)
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    zones = {
        "square": [square, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]],  # a hole, edges on cell borders
        "in the hole": [[(1.5, 1.5), (2.5, 1.5), (2.0, 2.6)]],
        "date line": [[(170.3, -10.2), (190.7, -12.0), (186.0, 8.8), (172.0, 5.1)]],
        "far west": [[(-191.0, 40.0), (-170.0, 41.0), (-175.5, 55.0)]],
        "needle": [[(-50.01, -50.0), (-50.0, 60.0), (-49.99, -50.0)]],
        "star": [[(20 + (9 if k % 2 else 2.5) * c, 40 + (9 if k % 2 else 2.5) * s) for k, (c, s) in enumerate([(1, 0), (0.8, 0.6), (0.3, 0.95), (-0.3, 0.95), (-0.8, 0.6), (-1, 0), (-0.8, -0.6), (-0.3, -0.95), (0.3, -0.95), (0.8, -0.6)])]],
        "two parts": [[(60.2, 0.1), (60.9, 0.1), (60.9, 0.8)], [(70.0, 0.0), (79.5, 0.0), (79.5, 9.5)]],
    }
    places = [(r.uniform(-15, 62), r.uniform(-180, 180)) for _ in range(600)] + [(r.uniform(-1, 5), r.uniform(-1, 5)) for _ in range(400)] + [(r.uniform(-13, 10), r.choice([-1, 1]) * r.uniform(169, 180)) for _ in range(300)]
    places += [(r.uniform(29, 51), r.uniform(9, 31)) for _ in range(300)] + [(r.uniform(-51, 61), r.uniform(-50.02, -49.98)) for _ in range(200)]
    places += [(float(y), float(x)) for y in range(-1, 6) for x in range(-1, 6)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, -180.0), (0.0, 180.0)]
    df = spark.createDataFrame([(*p, "old", i) for i, p in enumerate(places)], "lat double, lon double, zone string, n long")
    outlines = spark.createDataFrame([(z, [(float(a), float(b)) for a, b in ring]) for z, rings in zones.items() for ring in rings] + [("bad", [(0.0, 0.0), None, (9.0, 9.0)]), ("short", [(0.0, 0.0), (1.0, 1.0)]), (None, square), ("null", None)], OUTLINES)
    got = zone_in_outlines(df, outlines, "none").collect()
    assert len(got) == len(places)
    want = expected(set(places), zones)
    assert {(x["lat"], x["lon"]): x["zone"] for x in got} == want and set(want.values()) == set(zones) | {"none"}


def test_odd_places_and_no_outlines(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, 400.0), (2.0, 2.0), (2.0, 2.0)], "lat double, lon double")
    none = spark.createDataFrame([], OUTLINES)
    assert [x["zone"] for x in zone_in_outlines(df, none, "d").collect()] == ["d"] * 6
    assert zone_in_outlines(df.limit(0), none, "d").count() == 0


def test_only_cells_of_edges_are_cast(spark):
    big = spark.createDataFrame([("z", [(0.5, 0.5), (60.5, 0.5), (60.5, 60.5), (0.5, 60.5)])], OUTLINES)
    on_edge, whole = zone_cells(outline_edges(big))
    assert on_edge.count() == 4 * 60 and whole.count() == 59 * 59
    assert on_edge.join(whole, ["zone", "cx", "cy"]).count() == 0
    assert whole.agg(F.min("cx"), F.max("cy")).first() == (1, 59)
