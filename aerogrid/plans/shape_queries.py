"""Queries on polygons of many rings and lines of many points, read as WKT, each with its SQL by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import class_weight
from ..operators import aggregates as A
from ..operators import shapes as H
from ..operators import spatial as X
from .tables import Tables

Q: dict = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


#: Whether (x, y) is in an estate: a square with two holes, a triangle and a square of its own.
IN_ESTATE = """(x >= x0 AND x < x0 + 600 AND y >= y0 AND y < y0 + 600 AND NOT (x >= x0 + 50 AND x < x0 + 150 AND y >= y0 + 50 AND y < y0 + 150) AND NOT (x >= x0 + 200 AND x < x0 + 550 AND y >= y0 + 200 AND y < y0 + 500)
    OR x >= x0 + 700 AND y >= y0 AND (x - x0 - 700) + (y - y0) < leg OR x >= x0 AND x < x0 + 100 AND y >= y0 + 700 AND y < y0 + 800)"""


def _estates(t: Tables):
    return H.wkt_edges(t.estates, "wkt", ["zone"])


@query("SELECT zone, 3::BIGINT AS parts, 5::BIGINT AS rings, 19::BIGINT AS edges, round(2400 + 400 + 1300 + 400 + leg * (2 + sqrt(2::DOUBLE)), 3) AS length FROM {estates}")
def wkt_edges(t: Tables):
    """Parts, rings, edges and their whole length for each multipolygon."""
    e = _estates(t).groupBy("zone").agg(
        F.count_distinct("part").alias("parts"), F.count_distinct("part", "ring").alias("rings"), F.count(F.lit(1)).alias("edges"),
        F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("length"),
    )
    return e


@query(f"SELECT eid, zone FROM {{emitters}}, {{estates}} WHERE {IN_ESTATE}")
def multi_ring_within(t: Tables):
    return X.points_within(t.emitters.select("eid", "x", "y"), _estates(t), "zone").select("eid", "zone")


@query(f"SELECT eid FROM {{emitters}} WHERE EXISTS (SELECT 1 FROM {{estates}} WHERE zone % 2 = 0 AND {IN_ESTATE})")
def multi_ring_clip(t: Tables):
    return X.points_within(t.emitters, _estates(t).filter("zone % 2 = 0"), "zone", "left_semi").select("eid")


@query(
    f"""SELECT zone, coalesce(w, 0)::DOUBLE AS weight FROM {{estates}} LEFT JOIN (
      SELECT zone, sum(CASE kind WHEN 'class 1' THEN 80 WHEN 'class 2' THEN 20 WHEN 'class 3' THEN 10 WHEN 'class 4' THEN 2 WHEN 'class 5' THEN 0.25 ELSE 0 END::DOUBLE) AS w FROM {{emitters}}, {{estates}} WHERE {IN_ESTATE} GROUP BY zone
    ) s USING (zone)"""
)
def multi_ring_sources(t: Tables):
    """Weighted emitters for each multipolygon, holes left out."""
    places = t.emitters.groupBy("x", "y").agg(F.sum(class_weight("kind")).alias("all_weight"))  # emitters of a place are in the same estates
    inside = X.points_within(places, _estates(t), "zone")
    return A.weighted_sources(t.estates.select("zone"), inside, "zone", F.col("all_weight"), "weight")


@query(
    f"""WITH k AS (SELECT *, EXISTS (SELECT 1 FROM {{estates}} WHERE {IN_ESTATE}) AS inside FROM {{gridpoints}}), e AS (SELECT * FROM {{emitters}} WHERE EXISTS (SELECT 1 FROM {{estates}} WHERE {IN_ESTATE})),
    d AS (SELECT p.pid, e.emission AS v, sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)) AS d FROM k p, e WHERE p.inside),
    s AS (SELECT pid, sum(v * 0.75 * (1 - (d / 800) * (d / 800))) / nullif(sum(0.75 * (1 - (d / 800) * (d / 800))), 0) AS m FROM d WHERE d <= 800 GROUP BY pid)
    SELECT p.pid, round(m, 3) AS emission FROM {{gridpoints}} p LEFT JOIN s USING (pid)"""
)
def multi_ring_kernel(t: Tables):
    """Kernel means of what lies in a region of many rings, at its points. Estates of one shape and place are one."""
    shapes = t.estates.groupBy("wkt").agg(F.min("zone").alias("feature"))
    return X.kernel_sources(t.gridpoints, t.emitters, "pid", 800, "epanechnikov", clip=H.wkt_edges(shapes, "wkt", ["feature"])).withColumn("emission", F.round("emission", 3))


SEGMENTS = """s AS (SELECT link_id, x1, y1, x2, y2 FROM {polylines} UNION ALL SELECT link_id, x2, y2, x3, y3 FROM {polylines} UNION ALL SELECT link_id, x4, y4, x5, y5 FROM {polylines})"""
ALONG = "least(1, greatest(0, coalesce(((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / nullif((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1), 0), 0)))"


@query(
    f"""WITH {SEGMENTS}, n AS (SELECT p.pid, s.link_id, sqrt(pow(p.x - s.x1 - {ALONG} * (s.x2 - s.x1), 2) + pow(p.y - s.y1 - {ALONG} * (s.y2 - s.y1), 2)) AS d FROM {{points}} p, s)
    SELECT pid, arg_min(link_id, (d, link_id)) AS link_id, round(min(d), 3) AS distance FROM n GROUP BY pid"""
)
def polyline_nearest(t: Tables):
    """The nearest road and its distance, roads being read as lines of many points."""
    s = H.wkt_edges(t.polylines, "wkt", ["link_id"])
    return X.nearest_segment(t.points, s, "pid", "link_id").select("pid", "link_id", F.round("distance", 3).alias("distance"))
