"""Polygons of many rings and lines of many points, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_shapes import holds, star

from aerogrid.operators import shapes as H
from aerogrid.operators import spatial as X
from aerogrid.sources import readers as S


def text_of(ring):
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + ")"


def geometry(parts):
    """WKT of parts, each a list of rings."""
    polygons = ["(" + ",".join(map(text_of, rings)) + ")" for rings in parts]
    return "POLYGON " + polygons[0] if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(polygons)})"


def within(parts, x, y):
    return sum(holds(ring, x, y) for rings in parts for ring in rings) % 2 == 1


@pytest.fixture(scope="module")
def features():
    r = random.Random(21)
    out = {i: [[star(r, r.randrange(3, 12)) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 4))] for i in range(30)}
    out[100] = [[[(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6)], [(20, 20), (20, 60), (60, 60), (60, 20)], [(70, 70), (75, 70), (75, 75)]]]  # a country with two holes
    out[101] = [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(10, 0), (11, 0), (11, 1), (10, 1)]], [[(0, 10), (1, 10), (1, 11), (0, 11)]]]
    out[102] = [[[(5, 5), (5, 5), (5, 5)]], [[(0, 3), (9, 3), (4, 3)]]]  # without area
    return {i: [[[(float(x), float(y)) for x, y in ring] for ring in rings] for rings in parts] for i, parts in out.items()}


@pytest.fixture(scope="module")
def table(spark, features):
    df = spark.createDataFrame([(i, geometry(parts)) for i, parts in features.items()], "zone int, wkt string")
    return df.withColumns({c: F.lit("clash") for c in ("part", "ring", "x", "y", "points", "kind")})


def test_points_in_many_rings(spark, features, table):
    r = random.Random(22)
    points = [(i, r.uniform(-20, 120), r.uniform(-20, 120)) for i in range(400)] + [(i, float(i % 12), float(i // 12 % 12)) for i in range(400, 544)]
    points += [(900, None, 1.0), (901, math.nan, 1.0), (902, math.inf, 1.0), (903, 1.0, -math.inf), (904, 1e300, 1e300), (905, -0.0, 0.0), (906, 3.0, 3.0), (906, 3.0, 3.0)]
    df = spark.createDataFrame(points, "pid int, x double, y double").withColumns({c: F.lit("clash") for c in ("slab", "level", "cx", "f", "count", "_f")})
    edges = H.wkt_edges(table, "wkt", ["zone"])
    got = X.points_within(df, edges, "zone")
    known = [(i, x, y) for i, x, y in points if x is not None and abs(x) < math.inf and abs(y) < math.inf]
    want = sorted((i, z) for i, x, y in known for z, parts in features.items() if within(parts, x, y))
    assert sorted((x["pid"], x["zone"]) for x in got.collect()) == want and got.columns == [*df.columns, "zone"]
    some = X.points_within(df, edges.filter("zone < 30"), "zone", "left_semi")
    assert sorted(x["pid"] for x in some.collect()) == sorted(i for i, x, y in known if any(within(features[z], x, y) for z in range(30)))
    assert X.points_within(df, edges.limit(0), "zone").count() == X.points_within(df.limit(0), edges, "zone").count() == 0


def test_three_squares_are_three_squares(spark, table):
    """Edges between rings are no edges: a point outside all squares is outside."""
    df = spark.createDataFrame([(1, 3.0, 3.0), (2, 0.5, 0.5), (3, 10.5, 0.5), (4, 0.5, 10.5)], "pid int, x double, y double")
    edges = H.wkt_edges(table.filter("zone = 101"), "wkt", ["zone"])
    assert sorted(r["pid"] for r in X.points_within(df, edges, "zone").collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="several rings"):
        table.filter("zone = 101").select(S.parse_wkt("wkt")).collect()


def test_a_ring_of_many_points(spark):
    """100,000 corners: a point meets a few edges, and cutting at most doubles the rows (and the ends of edges)."""
    n = 100_000
    k = F.col("id") * (2 * math.pi / n)
    ring = spark.range(n).select("id", (1000 + F.cos(k) * (900 + F.sin(k * 40) * 50)).alias("x"), (F.sin(k) * (900 + F.sin(k * 40) * 50)).alias("y"))
    nxt = ring.select(((F.col("id") - 1 + n) % n).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = ring.join(nxt, "id").select(F.lit("lake").alias("zone"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    boxes = H.feature_boxes(edges, "zone")
    slabs = H.cut_to_slabs(edges, boxes, "zone").groupBy("slab").count()
    most, total = slabs.agg(F.max("count"), F.sum("count")).first()
    assert most < 100 and total < 3 * n
    r = random.Random(5)
    pts = spark.createDataFrame([(i, r.uniform(-100, 2100), r.uniform(-1100, 1100)) for i in range(2000)], "id int, x double, y double")
    got = {x["id"] for x in X.points_within(pts, edges, "zone", "left_semi").collect()}
    for p in pts.collect():
        turn = math.atan2(p["y"], p["x"] - 1000) % (2 * math.pi)
        edge = 900 + math.sin(turn * 40) * 50
        away = math.hypot(p["x"] - 1000, p["y"])
        if abs(away - edge) > 1e-3:
            assert (p["id"] in got) == (away < edge)


def test_text_of_all_kinds(spark):
    texts = {
        1: "POINT (1 2)", 2: "srid=5179; multipoint((1 2), (3 4))", 3: "LINESTRING Z (0 0 5, 3 4 5, 3 4 6)", 4: "MultiLineString((0 0, 1 1),(2 2,3 3,4 4))",
        5: "POLYGON((0 0, 2 0, 2 2))", 6: " POLYGON ( (0 0, 2 0, 2 2, 0 0) , (1 1, 1.5 1, 1.5 1.25, 1 1) )", 7: "POLYGON EMPTY", 8: None, 9: "LINESTRING (7e0 -8.5)",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, wkt string")
    rings = {(r["id"], r["part"], r["ring"]): [tuple(p) for p in r["points"]] for r in H.wkt_rings(df, "wkt", ["id"]).collect()}
    assert rings[1, 0, 0] == [(1, 2)] and rings[2, 0, 0] == [(1, 2), (3, 4)] and rings[3, 0, 0] == [(0, 0), (3, 4), (3, 4)]
    assert rings[4, 1, 0] == [(2, 2), (3, 3), (4, 4)] and rings[6, 0, 1][2] == (1.5, 1.25) and rings[9, 0, 0] == [(7, -8.5)]
    assert {k[0] for k in rings} == {1, 2, 3, 4, 5, 6, 9}
    edges = {}
    for e in H.wkt_edges(df, "wkt", ["id"]).collect():
        edges.setdefault((e["id"], e["part"], e["ring"]), {})[e["nth"]] = (e["x1"], e["y1"], e["x2"], e["y2"])
    assert {k: len(v) for k, v in edges.items()} == {(3, 0, 0): 2, (4, 0, 0): 1, (4, 1, 0): 2, (5, 0, 0): 3, (6, 0, 0): 3, (6, 0, 1): 3, (9, 0, 0): 1}
    assert edges[5, 0, 0][2] == (2, 2, 0, 0) and edges[9, 0, 0][0] == (7, -8.5, 7, -8.5)
    for bad in ("CIRCLE (1 2)", "POINT (1)", "POLYGON ((0 0, 1 nan, 2 2))", "nothing"):
        with pytest.raises(Exception, match="geometry that can be read|no coordinates"):
            H.wkt_rings(spark.createDataFrame([(1, bad)], "id int, wkt string"), "wkt", ["id"]).collect()


def test_an_edge_without_an_end_fails(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)], "pid int, x double, y double")
    edges = spark.createDataFrame([(1, 0.0, 0.0, 1.0, None)], "zone int, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="no finite number"):
        X.points_within(df, edges, "zone").collect()
    with pytest.raises(ValueError, match="of their own"):
        X.points_within(df.withColumn("zone", F.lit(1)), edges, "zone")


def test_a_null_feature_is_one(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5)], "pid int, x double, y double")
    square = [(None, 0.0, 0.0, 1.0, 0.0), (None, 1.0, 0.0, 1.0, 1.0), (None, 1.0, 1.0, 0.0, 1.0), (None, 0.0, 1.0, 0.0, 0.0)]
    got = X.points_within(df, spark.createDataFrame(square, "zone int, x1 double, y1 double, x2 double, y2 double"), "zone").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, 0.5, None)]


def test_nearest_of_places_without_end(spark):
    pts = spark.createDataFrame([(1, 0.0, 5.0), (2, math.inf, 0.0), (3, 0.0, -math.inf), (4, math.nan, 0.0), (5, None, 0.0), (6, 1e6, 5.0)], "pid int, x double, y double")
    roads = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 0.0), (2, math.inf, 0.0, 9.0, 0.0), (3, 0.0, math.nan, 9.0, 0.0)], "link int, x1 double, y1 double, x2 double, y2 double")
    got = {r["pid"]: (r["link"], round(r["distance"], 3)) for r in X.nearest_segment(pts, roads, "pid", "link").collect()}
    assert got == {1: (1, 5.0), 6: (1, round(math.hypot(1e6 - 9, 5), 3))}
    assert X.nearest_segment(pts, roads.filter("link > 1"), "pid", "link").count() == 0


def test_clip_by_edges_is_clip_by_rings(spark):
    r = random.Random(8)
    ring = star(r, 9)
    pts = spark.createDataFrame([(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(80)], "pid int, x double, y double")
    sources = pts.withColumn("emission", F.col("pid") * 1.5)
    rings = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    edges = H.edges_of(rings.withColumn("feature", F.lit(1)), ["feature"], points="ring")
    a, b = ({x["pid"]: x["emission"] for x in X.kernel_sources(pts, sources, "pid", 30, "tricube", clip=c).collect()} for c in (rings, edges))
    assert a == pytest.approx(b) and len([v for v in a.values() if v is not None]) > 3
