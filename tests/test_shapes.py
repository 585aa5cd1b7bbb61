"""Polygons of any shape, against counting crossings and walking edges in plain Python."""

import math
import random

import pytest

from aerogrid.operators import spatial as X


def star(r, n):
    """A ring whose corners lie at odd distances around a centre."""
    cx, cy = r.uniform(0, 100), r.uniform(0, 100)
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + d * math.cos(t), cy + d * math.sin(t)) for t in turns for d in [r.uniform(3, 40)]]


def holds(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def rings():
    r = random.Random(11)
    return {i: star(r, r.randrange(3, 9)) for i in range(25)}


@pytest.fixture(scope="module")
def polygons(spark, rings):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring]) for i, ring in rings.items()], "zone int, ring array<struct<x:double,y:double>>")


def test_points_in_any_polygon(spark, rings, polygons):
    r = random.Random(12)
    points = [(i, r.uniform(-20, 120), r.uniform(-20, 120)) for i in range(300)]
    df = spark.createDataFrame(points, "pid int, x double, y double")
    for size in (7.0, 1000.0):
        got = {(x["pid"], x["zone"]) for x in X.points_in_polygons(df, polygons, size, ["zone"]).collect()}
        assert got == {(i, z) for i, x, y in points for z, ring in rings.items() if holds(ring, x, y)}


def test_cells_that_meet_a_region(spark, rings, polygons):
    extent = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0)], "xmin double, ymin double, xmax double, ymax double")
    region = polygons.filter("zone < 6")
    every = X.auto_grid(extent, 1.0, 12).collect()
    assert len(every) == 144
    got = {(x["row"], x["col"]) for x in X.auto_grid(extent, 1.0, 12, region).collect()}

    def meets(c):
        for z in range(6):
            ring = rings[z]
            if holds(ring, c["xmin"], c["ymin"]):
                return True
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                for k in range(2001):  # points along the edge
                    x, y = ax + (bx - ax) * k / 2000, ay + (by - ay) * k / 2000
                    if c["xmin"] <= x <= c["xmax"] and c["ymin"] <= y <= c["ymax"]:
                        return True
        return False

    want = {(c["row"], c["col"]) for c in every if meets(c)}
    assert want <= got and len(got - want) <= 1  # an edge may cut a corner between two of the points
    assert 0 < len(got) < 144


def test_sources_outside_the_clip_do_not_count(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0)], "pid int, x double, y double")
    s = spark.createDataFrame([(4.0, 5.0, 10.0), (11.0, 5.0, 90.0)], "x double, y double, emission double")
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    clip = spark.createDataFrame([([{"x": x, "y": y} for x, y in corners],)], "ring array<struct<x:double,y:double>>")
    for name in ("gaussian", "tricube"):
        got = {x["pid"]: x["emission"] for x in X.kernel_sources(p, s, "pid", 20, name, clip=clip).collect()}
        assert got == {1: pytest.approx(10.0), 2: None}


def test_a_place_without_segments_or_coordinates(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "pid int, x double, y double")
    r = spark.createDataFrame([(7, 3.0, 4.0, 3.0, 9.0)], "link_id int, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(x) for x in X.nearest_segment(p, r, "pid", "link_id").collect()] == [(1, 7, 5.0)]
    assert X.nearest_segment(p, r.limit(0), "pid", "link_id").collect() == []


def test_nearest_segments_against_all(spark):
    r = random.Random(5)
    links = [(i, *(r.uniform(0, 3000) for _ in range(4))) for i in range(40)] + [(90, 50_000.0, 0.0, 50_000.0, 10.0)]
    points = [(i, r.uniform(-500, 3500), r.uniform(-500, 3500)) for i in range(80)] + [(200, 30_000.0, 0.0), (201, -1e6, 5.0)]

    def far(x, y, x1, y1, x2, y2):
        s = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / s)) if s else 0
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    out = X.nearest_segment(spark.createDataFrame(points, "pid int, x double, y double"), spark.createDataFrame(links, "link_id int, x1 double, y1 double, x2 double, y2 double"), "pid", "link_id", 3)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    got = {x["pid"]: (x["link_id"], x["distance"]) for x in out.collect()}
    for i, x, y in points:
        d, link = min((far(x, y, *seg), k) for k, *seg in links)
        assert got[i] == (link, pytest.approx(d))
