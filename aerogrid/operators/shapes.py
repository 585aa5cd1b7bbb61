"""Geometries as tables of edges: polygons of many parts and rings, lines of many points, and points within polygons.

An edge is a row (feature, part, ring, nth, x1, y1, x2, y2). A feature's edges are cut into horizontal slabs, as many as its edges are short, so that a
point meets about as many edges as a line across the feature does, however many the feature has. Parity is a count over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, small

POLYGONS, LINES, POINTS = ("POLYGON", "MULTIPOLYGON"), ("LINESTRING", "MULTILINESTRING"), ("POINT", "MULTIPOINT")
_BETWEEN_PARTS, _BETWEEN_RINGS = r"\)\s*\)\s*,\s*\(\s*\(", r"\)\s*,\s*\("


def finite(*cols: Column | str) -> Column:
    """Whether all of the numbers are known and finite."""
    out = F.lit(True)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out &= F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return out


def _coordinates(text: Column) -> Column:
    """ARRAY<STRUCT<x, y>> of "x y, x y, ..."; further numbers of a point (height, measure) are left out."""

    def point(p: Column) -> Column:
        parts = F.split(F.trim(p), r"\s+")
        x, y = (F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1))
        bad = F.raise_error(F.concat(F.lit("no coordinates: "), F.substring(p, 1, 60)))
        return F.when(finite(x, y), F.struct(x.alias("x"), y.alias("y"))).otherwise(bad)

    return F.transform(F.split(F.regexp_replace(text, r"[()]", " "), ","), point)


def wkt_rings(df: DataFrame, wkt: str, keep: Sequence[str]) -> DataFrame:
    """keep, kind, part, ring and points of each ring, line or point set of a WKT column.

    POINT, LINESTRING, POLYGON and their MULTI forms are read, in any case, with or without an SRID and with further dimensions left out.
    part counts the members of a MULTI form from 0, ring the rings of a polygon: 0 is its outline, others are holes. Null and empty geometries have no
    row. Any other kind, and a coordinate that is no finite number, fail the job with the text's beginning.
    """
    text = F.regexp_replace(F.col(wkt), r"(?i)^\s*(SRID=\d+\s*;)?\s*", "")
    kind = F.upper(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    body = F.regexp_extract(text, r"(?s)\((.*)\)", 1)
    rings = lambda t: F.split(t, _BETWEEN_RINGS)
    parts = (
        F.when(kind == "MULTIPOLYGON", F.transform(F.split(body, _BETWEEN_PARTS), rings))
        .when(kind == "POLYGON", F.array(rings(body)))
        .when(kind == "MULTILINESTRING", F.transform(rings(body), lambda t: F.array(t)))
        .when(kind.isin("LINESTRING", *POINTS), F.array(F.array(body)))
        .otherwise(F.raise_error(F.concat(F.lit("no geometry that can be read: "), F.substring(F.col(wkt), 1, 60))))
    )
    known = df.filter(F.col(wkt).isNotNull() & ~F.col(wkt).rlike(r"(?i)\bEMPTY\s*$"))
    known = known.select(*keep, kind.alias("kind"), F.posexplode(parts).alias("part", "rings"))
    known = known.select(*keep, "kind", "part", F.posexplode("rings").alias("ring", "text"))
    return known.select(*keep, "kind", "part", "ring", _coordinates(F.col("text")).alias("points"))


def edges_of(rings: DataFrame, keep: Sequence[str], closed: Column | bool = True, points: str = "points") -> DataFrame:
    """A row (keep, nth, x1, y1, x2, y2) for each two neighbouring points of an array of struct(x, y); closed ones end where they begin.

    An array of one point is an edge of no length; null and empty arrays have none.
    """
    p = F.col(points)
    closed = F.lit(closed) if isinstance(closed, bool) else closed
    p = F.when(closed & (F.get(p, F.lit(0)) != F.element_at(p, -1)) | (F.size(p) == 1), F.concat(p, F.slice(p, 1, 1))).otherwise(p)
    rows = rings.filter(F.size(points) > 0).select(*keep, p.alias("_p"))
    n = F.size("_p") - 1
    pairs = F.arrays_zip(F.slice("_p", F.lit(1), n).alias("a"), F.slice("_p", F.lit(2), n).alias("b"))
    rows = rows.select(*keep, F.posexplode(pairs).alias("nth", "e"))
    return rows.select(*keep, "nth", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def wkt_edges(df: DataFrame, wkt: str, keep: Sequence[str]) -> DataFrame:
    """keep, part, ring, nth, x1, y1, x2, y2 of polygons (closed) and lines; other kinds have no edge. As wkt_rings else."""
    rings = wkt_rings(df, wkt, keep)
    shapes = rings.filter(F.col("kind").isin(*POLYGONS, *LINES))
    return edges_of(shapes, [*keep, "part", "ring"], F.col("kind").isin(*POLYGONS))


def _slab(y: Column) -> Column:
    """The number of a feature's slab at a height: never falls as y grows, so an edge's slabs hold those of all heights on it."""
    return F.greatest(F.lit(0), F.least(F.col("slabs") - 1, F.floor((y - F.col("ymin")) * F.col("slabs") / F.nullif(F.col("ymax") - F.col("ymin"), F.lit(0.0)))))


def feature_boxes(edges: DataFrame, feature: str) -> DataFrame:
    """feature, xmin, ymin, xmax, ymax, and the number of slabs: edges x height / sum of their heights, so that cutting at most doubles the rows."""
    rise = F.abs(F.col("y2") - F.col("y1"))
    x, y = (F.least("x1", "x2"), F.greatest("x1", "x2")), (F.least("y1", "y2"), F.greatest("y1", "y2"))
    boxes = edges.groupBy(feature).agg(
        F.min(x[0]).alias("xmin"), F.min(y[0]).alias("ymin"), F.max(x[1]).alias("xmax"), F.max(y[1]).alias("ymax"), F.count_if(rise > 0).alias("n"), F.sum(rise).alias("rise")
    )
    slabs = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * (F.col("ymax") - F.col("ymin")) / F.nullif(F.col("rise"), F.lit(0.0))))
    return boxes.filter((F.col("ymax") > F.col("ymin")) & (F.col("xmax") > F.col("xmin"))).withColumn("slabs", slabs).drop("n", "rise")


def cut_to_slabs(edges: DataFrame, boxes: DataFrame, feature: str) -> DataFrame:
    """feature, slab, x1, y1, x2, y2: level edges left out, the others once for each slab of their feature that they touch."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.filter(F.col("y1") != F.col("y2")).join(small(boxes.select(feature, "ymin", "ymax", "slabs")), feature)
    return rows.select(feature, F.explode(F.sequence(_slab(low), _slab(high))).alias("slab"), "x1", "y1", "x2", "y2")


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def points_within(points: DataFrame, edges: DataFrame, feature: str, how: str = "inner") -> DataFrame:
    """Points (x, y) with each polygon feature that they are in; left_semi: the points that are in any, as they are.

    A point is in a feature if a line from it to the right crosses an odd number of the feature's edges: holes are outside, and so is what
    two parts both cover. Edges are half open, so that of two features with a common border one holds each point of it. edges: feature, x1, y1, x2, y2,
    all rings closed; an edge with a null or non-finite coordinate fails the job, a null feature is a feature. Points without a finite place are in
    none. Repeated points are given each, those of one place are looked up once. A column of points named as the feature is refused.

    Features are found by the cells of about their own box's size that it touches (four at most), so a country is as few rows as a plot; a point looks
    once at each of the sizes that occur. Then point and feature meet the edges of one slab.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"no join {how}")
    if feature in points.columns and how == "inner":
        raise ValueError(f"points have a column {feature} of their own")
    named = F.struct(F.col(feature).alias("f")).alias("_f")  # a null name joins as a struct
    bad = F.raise_error(F.lit("an edge has a coordinate that is no finite number"))
    e = edges.select(named, *[F.when(finite("x1", "y1", "x2", "y2"), F.col(c).cast("double")).otherwise(bad).alias(c) for c in ("x1", "y1", "x2", "y2")])
    boxes = cut(feature_boxes(e, "_f"))
    level = F.ceil(F.log2(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))
    boxes = boxes.withColumn("level", level)
    levels = [r[0] for r in boxes.select("level").distinct().collect()]  # exponents of doubles: some 2,000 at most
    slabs = cut(cut_to_slabs(e, boxes, "_f"))

    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite("x", "y")).distinct()
    looks = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<bigint>")))
    cell = [F.floor(F.col(c) / _size(F.col("level"))) for c in ("x", "y")]
    looks = looks.withColumn("cx", cell[0]).withColumn("cy", cell[1])
    spread = [F.explode(F.sequence(F.floor(F.col(f"{c}min") / _size(F.col("level"))), F.floor(F.col(f"{c}max") / _size(F.col("level"))))) for c in ("x", "y")]
    cells = boxes.withColumn("cx", spread[0]).withColumn("cy", spread[1])
    box = (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax"))
    pairs = looks.join(small(cells), ["level", "cx", "cy"]).filter(box).select("_f", "x", "y", _slab(F.col("y")).alias("slab"))

    straddles = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = pairs.join(small(slabs), ["_f", "slab"]).filter(straddles & (F.col("x") < at))
    inside = crossed.groupBy("_f", "x", "y").count().filter(F.col("count") % 2 == 1)
    if how == "left_semi":
        return points.join(inside.select(F.col("x").alias("_x"), F.col("y").alias("_y")), (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_semi")
    inside = inside.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_f.f").alias(feature))
    return points.join(inside, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).drop("_x", "_y")
