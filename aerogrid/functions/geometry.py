"""Geometry as Column arithmetic: distances, projections, rings, circles over cells."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6_371_008.8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres."""
    lon1, lat1, lon2, lat2 = (F.radians(_c(v)) for v in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


@F.pandas_udf(T.DoubleType())
def ellipsoid_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Distance in metres on the WGS84 ellipsoid; null where a coordinate is null, or points are antipodal."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    lo = np.radians((lon2 - lon1).to_numpy(float))
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(s.to_numpy(float)))) for s in (lat1, lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = lo.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / ss)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, cs - 2 * su1 * su2 / ca2)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = lo + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        u = ca2 * (a * a - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return pd.Series(b * big * (sigma - d))


class TransverseMercator(NamedTuple):
    """Parameters of a transverse Mercator grid on GRS80."""

    lon0: float
    lat0: float
    scale: float
    east: float
    north: float


#: The two national grids, by EPSG code.
GRIDS = {
    5179: TransverseMercator(127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0),
    5186: TransverseMercator(127.0, 38.0, 1.0, 200_000.0, 600_000.0),
}
_N = (1 / 298.257222101) / (2 - 1 / 298.257222101)
_RADIUS = 6_378_137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: The series of the projection in the third flattening, forward, back, and for latitude.
FORWARD = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
BACKWARD = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def _meridian(lat0: float) -> float:
    """Scaled northing of a latitude on the central meridian."""
    s = math.sin(math.radians(lat0))
    xi = math.atan(math.sinh(math.atanh(s) - _E * math.atanh(_E * s)))
    return _RADIUS * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(FORWARD, 1)))


def project_tm(lon, lat, grid: TransverseMercator = GRIDS[5179]) -> Column:
    """struct(x, y) in metres of longitude and latitude in degrees."""
    s = F.sin(F.radians(_c(lat)))
    turn = F.radians(_c(lon) - F.lit(grid.lon0))
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(F.lit(1.0) + t * t))
    north, east = xi, eta
    for j, a in enumerate(FORWARD, 1):
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    k = grid.scale * _RADIUS
    return F.struct(
        (F.lit(grid.east) + F.lit(k) * east).alias("x"),
        (F.lit(grid.north - grid.scale * _meridian(grid.lat0)) + F.lit(k) * north).alias("y"),
    )


def unproject_tm(x, y, grid: TransverseMercator = GRIDS[5179]) -> Column:
    """struct(lon, lat) in degrees of grid coordinates."""
    k = grid.scale * _RADIUS
    xi = (_c(y) - F.lit(grid.north - grid.scale * _meridian(grid.lat0))) / F.lit(k)
    eta = (_c(x) - F.lit(grid.east)) / F.lit(k)
    north, east = xi, eta
    for j, b in enumerate(BACKWARD, 1):
        north = north - F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        east = east - F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for j, d in enumerate(LATITUDE, 1):
        lat = lat + F.lit(d) * F.sin(chi * (2 * j))
    lon = F.lit(grid.lon0) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def planar_m(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def segment_m(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment; a segment of no length is a point."""
    px, py, x1, y1, x2, y2 = (_c(v) for v in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / square)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def in_ring(px, py, ring) -> Column:
    """Whether a point is inside a ring of struct(x, y), by counting the edges that a ray to the right crosses.

    Edges are half open, so of two rings that share a border one holds each point of it.
    """
    px, py, ring = _c(px), _c(py), _c(ring)
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        straddles = (a["y"] > py) != (b["y"] > py)
        at = a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])
        return F.when(straddles, px < at).otherwise(F.lit(False))

    count = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i).cast("int"))
    return count % 2 == 1


def ring_meets_box(ring, xmin, ymin, xmax, ymax) -> Column:
    """Whether a ring of struct(x, y) and a box share a point: an edge enters the box, or the box lies within the ring."""
    ring, xmin, ymin, xmax, ymax = (_c(v) for v in (ring, xmin, ymin, xmax, ymax))
    n = F.size(ring)

    def inside(start: Column, step: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """The part of an edge, from 0 to 1, that lies between two bounds of one axis; an empty one is (2, -1)."""
        a, b = (low - start) / F.nullif(step, F.lit(0.0)), (high - start) / F.nullif(step, F.lit(0.0))
        still, between = step == 0, start.between(low, high)
        return (
            F.when(~still, F.least(a, b)).when(between, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(~still, F.greatest(a, b)).when(between, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    def enters(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        (x0, x1), (y0, y1) = inside(a["x"], b["x"] - a["x"], xmin, xmax), inside(a["y"], b["y"] - a["y"], ymin, ymax)
        return F.greatest(F.lit(0.0), x0, y0) <= F.least(F.lit(1.0), x1, y1)

    return F.exists(F.sequence(F.lit(0), n - 1), enters) | in_ring(xmin, ymin, ring)


def direction_features(dx, dy) -> dict[str, Column]:
    """Bearing sine and cosine, distance in km, and two damped forms of it."""
    dx, dy = _c(dx), _c(dy)
    bearing, km = F.atan2(dx, dy), F.hypot(dx, dy) / 1000.0
    return {
        "bearing_sin": F.sin(bearing), "bearing_cos": F.cos(bearing), "dist_km": km,
        "inv_dist": F.lit(1.0) / (km + 0.1), "log_dist": F.log(km + 1.0),
    }


def _corner(x: Column, y: Column, r: Column) -> Column:
    """Signed area of the circle about the origin over the rectangle between the origin and (x, y)."""
    a, b = F.least(F.abs(x), r), F.least(F.abs(y), r)
    from_ = F.sqrt(F.greatest(r * r - b * b, F.lit(0.0)))

    def under(t: Column) -> Column:
        return (t * F.sqrt(F.greatest(r * r - t * t, F.lit(0.0))) + r * r * F.asin(F.least(t / r, F.lit(1.0)))) / 2

    area = F.when(a * a + b * b <= r * r, a * b).otherwise(b * F.least(from_, a) + under(a) - under(F.least(from_, a)))
    return F.signum(x) * F.signum(y) * area


def circle_cover(cx, cy, r, xmin, ymin, xmax, ymax) -> Column:
    """Share of a rectangle that lies in a circle, in closed form."""
    cx, cy, r = _c(cx), _c(cy), _c(r)
    x0, x1, y0, y1 = _c(xmin) - cx, _c(xmax) - cx, _c(ymin) - cy, _c(ymax) - cy
    area = _corner(x1, y1, r) - _corner(x0, y1, r) - _corner(x1, y0, r) + _corner(x0, y0, r)
    return F.greatest(F.lit(0.0), area) / ((x1 - x0) * (y1 - y0))


def with_circle_cover(df: DataFrame, cx, cy, r, xmin, ymin, xmax, ymax, into: str = "cover") -> DataFrame:
    """df with the share of a rectangle that lies in a circle, as circle_cover has it, in steps: what corners have in common is computed once, and
    no step is too long to be compiled to machine code. Filters on the share aren't pushed below it, which would compute it twice.
    """
    cx, cy, r = _c(cx), _c(cy), _c(r)
    c = {n: F.col(f"_{n}") for n in ("r", "x0", "x1", "y0", "y1", "a0", "a1", "b0", "b1", "f0", "f1", "u0", "u1", *(f"{k}{i}{j}" for k in "ms" for i in "01" for j in "01"))}
    r2 = c["r"] * c["r"]

    def under(t: Column) -> Column:
        return (t * F.sqrt(F.greatest(r2 - t * t, F.lit(0.0))) + r2 * F.asin(F.least(t / c["r"], F.lit(1.0)))) / 2

    def corner(i: str, j: str) -> Column:
        a, b, m = c[f"a{i}"], c[f"b{j}"], c[f"m{i}{j}"]
        area = F.when(a * a + b * b <= r2, a * b).otherwise(b * m + c[f"u{i}"] - under(m))
        return F.signum(c[f"x{i}"]) * F.signum(c[f"y{j}"]) * area

    steps = [
        {"r": r, "x0": _c(xmin) - cx, "x1": _c(xmax) - cx, "y0": _c(ymin) - cy, "y1": _c(ymax) - cy},
        {f"{n}{i}": F.least(F.abs(c[f"{v}{i}"]), c["r"]) for n, v in (("a", "x"), ("b", "y")) for i in "01"},
        {f"f{j}": F.sqrt(F.greatest(r2 - c[f"b{j}"] * c[f"b{j}"], F.lit(0.0))) for j in "01"} | {f"u{i}": under(c[f"a{i}"]) for i in "01"},
        {f"m{i}{j}": F.least(c[f"f{j}"], c[f"a{i}"]) for i in "01" for j in "01"},
        {f"s{i}{j}": corner(i, j) for i in "01" for j in "01"},
    ]
    out = df
    for step in steps:
        out = out.withColumns({f"_{n}": v for n, v in step.items()})
    area = c["s11"] - c["s01"] - c["s10"] + c["s00"]
    share = F.greatest(F.lit(0.0), area) / ((c["x1"] - c["x0"]) * (c["y1"] - c["y0"]))
    return out.withColumn(into, F.explode(F.array(share))).drop(*[f"_{n}" for n in c])
