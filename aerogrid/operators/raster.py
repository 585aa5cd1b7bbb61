"""Rasters as tables of cells (row, col, value), and what is computed on them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quality_ok
from ..functions.geometry import with_circle_cover
from ..scratch import cut, small
from ..session import ship_package
from .joins import interval_join


class Frame(NamedTuple):
    """Where a raster lies: its upper left corner and the sizes of a cell."""

    x0: float
    y0: float
    dx: float
    dy: float

    def row(self, y) -> Column:
        return F.floor((F.lit(self.y0) - (F.col(y) if isinstance(y, str) else y)) / self.dy).cast("int")

    def col(self, x) -> Column:
        return F.floor(((F.col(x) if isinstance(x, str) else x) - F.lit(self.x0)) / self.dx).cast("int")


def sample_at_points(points: DataFrame, cells: DataFrame, frame: Frame, values: Sequence[str] = ("value",)) -> DataFrame:
    """points with the values of the cells that hold them; outside the raster, null. A raster is never broadcast: its files may be a tenth of its rows."""
    p = points.withColumns({"row": frame.row("y"), "col": frame.col("x")})
    return p.join(cells.select("row", "col", *values).hint("merge"), ["row", "col"], "left").drop("row", "col")


def buffer_cells(points: DataFrame, key: str, radii: Sequence[float], frame: Frame, coverage: str = "exact") -> DataFrame:
    """key, radius, row, col, cover: every cell that a circle about a point touches, and the share of it inside.

    coverage 'centre' takes cells whole whose centre is inside. A share below 1e-9 is rounding, not contact.
    """
    p = points.select(key, "x", "y").withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    p = p.withColumn("row", F.explode(F.sequence(frame.row(y + r), frame.row(y - r))))
    p = p.withColumn("col", F.explode(F.sequence(frame.col(x - r), frame.col(x + r))))
    left, top = F.lit(frame.x0) + F.col("col") * frame.dx, F.lit(frame.y0) - F.col("row") * frame.dy
    if coverage == "centre":
        mx, my = left + frame.dx / 2, top - frame.dy / 2
        inside = (mx - x) * (mx - x) + (my - y) * (my - y) <= r * r
        p = p.withColumn("cover", F.when(inside, 1.0))
    else:
        p = with_circle_cover(p, x, y, r, left, top - frame.dy, left + frame.dx, top)
    return p.filter(F.col("cover") > 1e-9).select(key, "radius", "row", "col", "cover")


#: Columns of a strip: a raster's rows are cut into strips, of which a circle takes whole ones by their sums.
STRIP = 64
#: Circles that a task makes into pieces.
CIRCLES = 1000


def circle_pieces(points: DataFrame, key: str, radii: Sequence[float], frame: Frame, coverage: str = "exact") -> DataFrame:
    """key, radius, row, strip, lo, hi, cover: circles as runs of whole cells from column lo to before hi, one strip each, and as
    single cells (hi = lo + 1) where the circle's line cuts them.

    The cells are those of buffer_cells; a circle of r cells across has about r rows of runs and r cut cells instead of r² cells.
    """
    p = points.select(key, "x", "y").dropna(subset=["x", "y"]).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    p = p.withColumn("row", F.explode(F.sequence(frame.row(y + r), frame.row(y - r))))
    top = F.lit(frame.y0) - F.col("row") * frame.dy
    west = x - F.lit(frame.x0)

    def reach(away: Column) -> Column:
        """Half the chord at a distance from the centre; null beyond the circle."""
        return F.when(away <= r, F.sqrt(r * r - away * away))

    if coverage == "centre":
        half = reach(F.abs(top - frame.dy / 2 - y))
        p = p.withColumns({"c0": F.ceil((west - half) / frame.dx - 0.5).cast("int"), "c1": F.floor((west + half) / frame.dx - 0.5).cast("int")})
    else:
        above, below = top - y, top - frame.dy - y
        whole = reach(F.greatest(F.abs(above), F.abs(below)))
        cut_ = reach(F.when((above >= 0) & (below <= 0), 0.0).otherwise(F.least(F.abs(above), F.abs(below))))
        p = p.withColumns({"c0": F.ceil((west - whole) / frame.dx).cast("int"), "c1": (F.floor((west + whole) / frame.dx) - 1).cast("int")})
        p = p.withColumns({"a": F.floor((west - cut_) / frame.dx).cast("int"), "z": F.floor((west + cut_) / frame.dx).cast("int")})
    runs = p.filter(F.col("c0") <= F.col("c1")).withColumn("strip", F.explode(F.sequence(F.floor(F.col("c0") / STRIP).cast("int"), F.floor(F.col("c1") / STRIP).cast("int"))))
    first, after = F.greatest("c0", F.col("strip") * STRIP), F.least(F.col("c1") + 1, (F.col("strip") + 1) * STRIP)
    runs = runs.select(key, "radius", "row", "strip", first.alias("lo"), after.alias("hi"), F.lit(1.0).alias("cover"))
    if coverage == "centre":
        return runs
    none, some = F.array().cast("array<int>"), F.col("c0") <= F.col("c1")
    before = F.when(F.col("a") < F.col("c0"), F.sequence(F.col("a"), F.col("c0") - 1)).otherwise(none)
    behind = F.when(F.col("c1") < F.col("z"), F.sequence(F.col("c1") + 1, F.col("z"))).otherwise(none)
    edge = p.filter(F.col("a").isNotNull()).withColumn("lo", F.explode(F.when(some, F.concat(before, behind)).otherwise(F.sequence("a", "z"))))
    left = F.lit(frame.x0) + F.col("lo") * frame.dx
    edge = with_circle_cover(edge, x, y, r, left, top - frame.dy, left + frame.dx, top).filter(F.col("cover") > 1e-9)
    edge = edge.select(key, "radius", "row", F.floor(F.col("lo") / STRIP).cast("int").alias("strip"), "lo", (F.col("lo") + 1).alias("hi"), "cover")
    return runs.unionByName(edge)


def zonal_sums(points: DataFrame, key: str, radii: Sequence[float], cells: DataFrame, frame: Frame, by: Sequence[str] = (), coverage: str = "exact") -> DataFrame:
    """key, radius, by..., total (of value times the share inside) and weight (the shares) of the known cells in each circle.

    Cells (row, col, by..., value; each once) are gathered to strips of a row, so the join is on (row, strip), whatever the raster's size.
    Points of one place are one circle. Strips that no circle reaches are left out; the rest are broadcast if they are small. Circles are
    dealt out before they become pieces, and pieces, which are many times the points, are never broadcast.
    """
    places = points.select("x", "y").dropna().distinct()
    x, y, far = F.col("x"), F.col("y"), max(float(r) for r in radii)
    ends = places.agg(
        F.count(F.lit(1)).alias("n"), F.min(frame.row(y + far)).alias("r0"), F.max(frame.row(y - far)).alias("r1"),
        F.min(frame.col(x - far)).alias("c0"), F.max(frame.col(x + far)).alias("c1"),
    ).first()
    known = cells.filter(F.col("value").isNotNull() & F.col("row").between(ends["r0"], ends["r1"]) & F.col("col").between(ends["c0"], ends["c1"]))
    strips = known.withColumn("strip", F.floor(F.col("col") / STRIP).cast("int")).groupBy("row", "strip", *by).agg(
        F.sum(F.col("value").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("col", F.col("value").cast("double").alias("value"))).alias("cells")
    )
    strips = small(cut(strips).withColumn("of", F.map_from_entries("cells")), F.size("cells") * 64 + 64)
    dealt = places.repartition(-(-ends["n"] // CIRCLES) or 1, "x", "y").withColumn("_place", F.struct("x", "y"))
    pieces = circle_pieces(dealt, "_place", radii, frame, coverage)
    all_, one = (F.col("hi") - F.col("lo")) == STRIP, (F.col("hi") - F.col("lo")) == 1
    single = F.element_at("of", F.col("lo"))
    inside = F.filter("cells", lambda c: (c["col"] >= F.col("lo")) & (c["col"] < F.col("hi")))
    value = F.when(all_, F.col("v")).when(one, F.coalesce(single, F.lit(0.0))).otherwise(F.aggregate(inside, F.lit(0.0), lambda a, c: a + c["value"]))
    number = F.when(all_, F.col("n")).when(one, F.when(single.isNotNull(), 1).otherwise(0)).otherwise(F.size(inside))
    found = pieces.hint("merge").join(strips, ["row", "strip"]).select("_place", "radius", *by, (value * F.col("cover")).alias("v"), (number * F.col("cover")).alias("w"))
    sums = found.groupBy("_place", "radius", *by).agg(F.sum("v").alias("total"), F.sum("w").alias("weight")).filter(F.col("weight") > 0)
    here = points.select(key, F.struct("x", "y").alias("_place")).join(sums.hint("merge"), "_place")
    return here.groupBy(key, "radius", *by).agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def zonal_mean(points: DataFrame, key: str, radii: Sequence[float], cells: DataFrame, frame: Frame, by: Sequence[str] = (), coverage: str = "exact") -> DataFrame:
    """key, radius, by..., mean of the known cells in each circle, weighted by the share inside."""
    found = zonal_sums(points, key, radii, cells, frame, by, coverage)
    return found.select(key, "radius", *by, (F.col("total") / F.col("weight")).alias("mean"))


def zonal_fraction(points: DataFrame, key: str, radii: Sequence[float], cells: DataFrame, frame: Frame, classes: Sequence[int], by: Sequence[str] = (), coverage: str = "exact") -> DataFrame:
    """key, by..., and landuse_frac_<class>_<radius> columns: the share of each class of the cells with one; 0 if absent."""
    known = cells.filter(F.col("class").isNotNull()).select("row", "col", "class", *by, F.lit(1.0).alias("value"))
    found = zonal_sums(points, key, radii, known, frame, ["class", *by], coverage)
    inside = {(k, r): (F.col("radius") == float(r)) & (F.col("class") == k) for k in classes for r in radii}
    total = {r: F.sum(F.when(F.col("radius") == float(r), F.col("weight"))) for r in radii}
    cols = [
        F.coalesce(F.sum(F.when(w, F.col("weight"))) / total[r], F.lit(0.0)).alias(f"landuse_frac_{k}_{int(r)}") for (k, r), w in inside.items()
    ]
    got = found.groupBy(key, *by).agg(*cols)
    if by:
        return got
    names = [c for c in got.columns if c != key]
    return points.select(key).join(got, key, "left").fillna(0.0, names)


def radius_cells(radius: float, pixel: float, metric: bool) -> int:
    """A radius in cells: metres are divided by the cell and rounded up; without a metric grid it is in cells."""
    return math.ceil(radius / pixel) if metric else int(radius)


def kernel_rows(r: int, shape: str = "disk") -> list[tuple[int, int]]:
    """(row, half width) of a kernel of 2 r + 1 rows.

    disk: dr² + dc² <= r²; wide: the same with r + 1/2, which is half the window; mask: the disk with the two cells beside
    each of its four tips (for r = 3 the 7 by 7 kernel of 3, 5, 7, 7, 7, 5, 3 cells); square: all.
    """
    if shape == "square":
        return [(d, r) for d in range(-r, r + 1)]
    if shape == "wide":
        return [(d, math.isqrt(((2 * r + 1) ** 2 - 4 * d * d) // 4)) for d in range(-r, r + 1)]
    rows = [(d, math.isqrt(r * r - d * d)) for d in range(-r, r + 1)]
    if shape == "mask":
        rows = [(d, max(h, r if abs(d) == 1 else 1 if abs(d) == r else 0)) for d, h in rows]
    elif shape != "disk":
        raise ValueError(f"no kernel {shape}")
    return rows


def kernel_offsets(spark, r: int, shape: str = "disk") -> DataFrame:
    """dr, dc, w of a kernel of ones: those of kernel_rows, or ring (the square's border)."""
    if shape == "ring":
        one = spark.range(-r, r + 1).select(F.col("id").cast("int").alias("dr")).withColumn("dc", F.explode(F.sequence(F.lit(-r), F.lit(r))))
        one = one.filter(F.greatest(F.abs("dr"), F.abs("dc")) == r)
    else:
        rows = F.array(*[F.struct(F.lit(d).alias("dr"), F.lit(h).alias("h")) for d, h in kernel_rows(r, shape)])
        one = spark.range(1).select(F.inline(rows)).select("dr", F.explode(F.sequence(-F.col("h"), F.col("h"))).alias("dc"))
    return one.withColumn("w", F.lit(1.0))


def with_halo(cells: DataFrame, tile: int, pad: int) -> DataFrame:
    """Every cell once for each tile (tr, tc) that reads it."""
    near = lambda c: F.sequence(F.floor((F.col(c) - pad) / tile), F.floor((F.col(c) + pad) / tile))
    return cells.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))


def focal_class_fraction(
    cells: DataFrame, classes: Sequence[int], radius: int, shape: str = "disk", denom: str = "valid",
    border: str = "truncate", empty: float | None = 0.0, tile: int = 512, size: tuple[int, int] | None = None,
) -> DataFrame:
    """row, col, class, fraction: the share of each class among the cells around each.

    cells: row, col, class (null or absent cells have none; each (row, col) once). shape is one of kernel_rows. denom 'valid' divides by the cells with a class, 'kernel' by all cells of the kernel; without
    any valid cell the fraction is `empty`. border 'zero' leaves 0 within radius of the raster's edge (its size
    given as rows, cols). Tiles with a halo are computed apart, from row sums: a disk costs its rows, not its cells.
    """
    ship_package(cells.sparkSession)
    rows = kernel_rows(radius, shape)
    full = float(sum(2 * h + 1 for _, h in rows))
    codes, side = list(classes), tile + 2 * radius

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iat[0]), int(pdf["tc"].iat[0])
        top, left = tr * tile - radius, tc * tile - radius
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        kind = pdf["class"].to_numpy(float)
        here = np.zeros((side, side), bool)
        here[r, c] = True

        def sums(mask: np.ndarray) -> np.ndarray:
            grid = np.zeros((side, side), np.int32)
            grid[r[mask], c[mask]] = 1
            along = np.zeros((side, side + 1), np.int32)
            np.cumsum(grid, axis=1, out=along[:, 1:])
            out = np.zeros((tile, tile), np.int32)
            for d, h in rows:
                band = along[radius + d : radius + d + tile]
                out += band[:, radius + h + 1 : radius + h + 1 + tile] - band[:, radius - h : radius - h + tile]
            return out

        valid = sums(~np.isnan(kind))
        own = here[radius : radius + tile, radius : radius + tile]
        at, present = np.nonzero(own), set(kind[~np.isnan(kind)])
        n, out = valid[at], []
        for k in codes:
            count = sums(kind == k)[at] if k in present else np.zeros(len(n), np.int32)
            f = count / full if denom == "kernel" else np.divide(count, n, out=np.full(len(n), np.nan), where=n > 0)
            f = np.where(n == 0, np.nan if empty is None else empty, f)
            out.append(pd.DataFrame({"row": at[0] + tr * tile, "col": at[1] + tc * tile, "class": k, "fraction": f}))
        got = pd.concat(out, ignore_index=True)
        if border == "zero" and size:
            edge = (got["row"] < radius) | (got["row"] >= size[0] - radius) | (got["col"] < radius) | (got["col"] >= size[1] - radius)
            got.loc[edge, "fraction"] = 0.0
        return got.astype({"row": "int32", "col": "int32", "class": "int32"})

    dealt = with_halo(cells.select("row", "col", F.col("class").cast("double").alias("class")), tile, radius)
    out = dealt.groupBy("tr", "tc").applyInPandas(run, "row int, col int, class int, fraction double")
    return out.withColumn("fraction", F.when(~F.isnan("fraction"), F.col("fraction")))


def focal_fraction_join(cells: DataFrame, offsets: DataFrame, classes: Sequence[int]) -> DataFrame:
    """The same by offsets in plain joins (valid denominator, truncated, 0 if empty): for small kernels."""
    spread = cells.filter(F.col("class").isNotNull()).crossJoin(F.broadcast(offsets))
    spread = spread.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), F.col("class").alias("k"))
    sums = spread.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("k") == c).alias(f"n{c}") for c in classes])
    wide = cells.select("row", "col").join(sums, ["row", "col"], "left")
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.col(f"n{c}") / F.col("n"), F.lit(0.0)).alias("fraction")) for c in classes])
    return wide.select("row", "col", F.inline(parts))


def lower_filter(cells: DataFrame, radius: int) -> DataFrame:
    """row, col, higher: the share of the ring at a distance of radius cells that is higher than the centre."""
    ring = kernel_offsets(cells.sparkSession, radius, "ring")
    spread = cells.crossJoin(F.broadcast(ring)).select(
        (F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), F.col("value").alias("v")
    )
    found = cells.join(spread, ["row", "col"], "left").groupBy("row", "col").agg(F.count_if(F.col("v") > F.col("value")).alias("n"))
    return found.select("row", "col", (F.col("n") / F.lit(8.0 * radius)).alias("higher"))


def block_aggregate(cells: DataFrame, factor: int = 11, edge: str = "keep", size: tuple[int, int] | None = None) -> DataFrame:
    """Coarser cells, the mean of known ones; edge 'truncate' leaves out blocks that the raster (rows, cols) cuts."""
    if edge == "truncate":
        cells = cells.filter((F.col("row") < size[0] // factor * factor) & (F.col("col") < size[1] // factor * factor))
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return cells.groupBy(*block).agg(F.avg("value").alias("value"))


def cell_median(cells: DataFrame, keys: Sequence[str], skip_na: bool = True, fill: float | None = None) -> DataFrame:
    """Median over time of each cell; without skip_na any null makes it null.

    Equal values of a cell are counted first: beyond some 128 cells a task, values that go straight into a median are all sorted.
    """
    median = F.percentile("value", 0.5, F.col("_n"))
    value = median if skip_na else F.when(F.count_if(F.col("value").isNull()) == 0, median)
    counts = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    out = counts.groupBy(*keys).agg(value.alias("value"))
    return out.fillna(fill, ["value"]) if fill is not None else out


def repeated_mean(cells: DataFrame, keys: Sequence[str], scale: float = 0.1) -> DataFrame:
    """Mean of repeated grids, nulls passed over, times a scale."""
    return cells.groupBy(*keys).agg((F.avg("value") * scale).alias("value"))


def align_to(template: DataFrame, cells: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """The template's cells with the raster's values, null where it has none."""
    return template.select(*keys).join(cells, list(keys), "left")


def temporal_aggregate(cells: DataFrame, time: str, how: Mapping[str, str], hours: int = 9) -> DataFrame:
    """row, col, variable, date, value: hourly values to local days, each variable's mean or sum."""
    day = F.to_date(F.col(time) + F.expr(f"INTERVAL {int(hours)} HOURS")).alias("date")
    summed = [v for v, f in how.items() if f == "sum"]
    value = F.when(F.col("variable").isin(summed) if summed else F.lit(False), F.sum("value")).otherwise(F.avg("value"))
    return cells.filter(F.col("variable").isin(list(how))).groupBy("row", "col", "variable", day).agg(value.alias("value"))


def distinct_classes(cells: DataFrame, nodata: int | None = None) -> DataFrame:
    df = cells.filter(F.col("class").isNotNull())
    return (df.filter(F.col("class") != nodata) if nodata is not None else df).select("class").distinct().orderBy("class")


def composite(cells: DataFrame, keys: Sequence[str], value: str = "aod", unc: str = "unc", qa: str = "qa", scale: float = 0.001) -> DataFrame:
    """Overpasses of good quality, scaled, into one value weighted by 1 / (uncertainty² + 1e-6)."""
    good = cells.filter(quality_ok(qa)).withColumns({"v": F.col(value) * scale, "u": F.col(unc) * scale})
    w = F.lit(1.0) / (F.col("u") * F.col("u") + F.lit(1e-6))
    known = F.col("v").isNotNull() & F.col("u").isNotNull()
    return good.groupBy(*keys).agg((F.sum(F.when(known, F.col("v") * w)) / F.nullif(F.sum(F.when(known, w)), F.lit(0.0))).alias("value"))


def mosaic(tiles: DataFrame, keys: Sequence[str] = ("row", "col"), order: str = "tile") -> DataFrame:
    """One value a cell: that of the first tile that has one."""
    known = tiles.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.min_by("value", order).alias("value"))
    return tiles.select(*keys).distinct().join(known, list(keys), "left")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "_b"), list(keys)).withColumn("value", F.col("value") - F.col("_b")).drop("_b")


def mask(a: DataFrame, by: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Values where the mask has one; elsewhere null."""
    m = by.filter(F.col("value").isNotNull()).select(*keys, F.lit(True).alias("_m"))
    return a.join(m, list(keys), "left").withColumn("value", F.when(F.col("_m"), F.col("value"))).drop("_m")


def raster_points(cells: DataFrame, frame: Frame, log: bool = False, km: bool = False) -> DataFrame:
    """x, y (of centres) and value, back from logarithms if asked for."""
    unit = 1000.0 if km else 1.0
    x = (F.lit(frame.x0) + (F.col("col") + 0.5) * frame.dx) / unit
    y = (F.lit(frame.y0) - (F.col("row") + 0.5) * frame.dy) / unit
    return cells.select(x.alias("x"), y.alias("y"), (F.exp("value") if log else F.col("value")).alias("value"))


def wind(u: Column | str, v: Column | str) -> dict[str, Column]:
    """Speed, and the direction in degrees that the wind comes from."""
    u, v = (F.col(x) if isinstance(x, str) else x for x in (u, v))
    return {"wind_speed": F.hypot(u, v), "wind_dir": F.degrees(F.atan2(u, v)) + 180.0}


#: Cells along the side of a tile of points, days, and points that a group holds; groups of a task.
DAY_TILE, DAYS, DAY_POINTS, DAY_GROUPS = 8, 128, 2000, 8


def zonal_days(points: DataFrame, key: str, radii: Sequence[float], cells: DataFrame, frame: Frame, values: Sequence[str], coverage: str = "exact") -> DataFrame:
    """key, date and <value>_<radius> columns: means of the known cells in each circle on each day, weighted by the share inside; null where none is known.

    cells: row, col, date, values... (each cell and date once). A point has a row for each date on which any of its circles holds a known value. Points of a tile,
    by parts of about DAY_POINTS, meet the cells in reach of the tile for DAYS days at a time; nothing but the result has a row for each point and day.
    """
    spark = points.sparkSession
    ship_package(spark)
    tile, kind, far = DAY_TILE, points.schema[key].dataType.simpleString(), max(float(r) for r in radii)
    names = [f"{v}_{int(r)}" for v in values for r in radii]
    placed = points.select(key, "x", "y").dropna(subset=["x", "y"]).withColumns({"tr": F.floor(frame.row("y") / tile).cast("int"), "tc": F.floor(frame.col("x") / tile).cast("int")})
    tiles = cut(placed.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / DAY_POINTS).cast("int").alias("parts")))
    total = tiles.agg(F.sum("n").alias("n"), F.sum("parts").alias("parts")).first()
    tiles = tiles.drop("n")
    known = F.lit(False)
    for v in values:
        known = known | F.col(v).isNotNull()
    c = cells.filter(known & F.col("date").isNotNull()).withColumn("day", F.unix_date("date"))
    c = c.select("row", "col", F.floor(F.col("day") / DAYS).cast("int").alias("span"), F.pmod("day", F.lit(DAYS)).cast("int").alias("day"), *[F.col(v).cast("double").alias(v) for v in values])
    spans = cut(c.select("span").distinct())
    down, over = math.ceil(far / frame.dy) + 1, math.ceil(far / frame.dx) + 1
    near = lambda name, pad: F.explode(F.sequence(F.floor((F.col(name) - pad) / tile).cast("int"), F.floor((F.col(name) + pad) / tile).cast("int")))
    c = c.withColumn("tr", near("row", down)).withColumn("tc", near("col", over)).join(small(tiles), ["tr", "tc"])
    c = c.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    p = placed.join(small(tiles), ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    p = p.withColumn("_point", F.struct(F.col(key).alias("k"), "tr", "tc", "part"))
    covers = buffer_cells(p.repartition(-(-(total["n"] or 0) // CIRCLES) or 1, "_point"), "_point", radii, frame, coverage).select("_point.*", "radius", "row", "col", "cover")
    covers = covers.crossJoin(F.broadcast(spans))  # a row for each span of days: some dozens
    count, reach = len(values), [float(r) for r in radii]

    def run(circles: pa.Table, grid: pa.Table) -> pa.Table:
        if not circles.num_rows or not grid.num_rows:
            return pa.table({"key": circles.column("k").slice(0, 0), "date": pa.array([], pa.date32()), **{c: pa.array([], pa.float64()) for c in names}})
        code = lambda t: t.column("row").to_numpy().astype(np.int64) * (1 << 32) + t.column("col").to_numpy()
        cell, at = np.unique(code(grid), return_inverse=True)  # in order, so that sums are always the same
        held = np.zeros((len(cell) + 1, 2, DAYS, count))  # values, and whether they are known; the last cell is none
        day = grid.column("day").to_numpy()
        for i, v in enumerate(values):
            has = ~np.asarray(grid.column(v).is_null())
            held[at[has], 0, day[has], i] = grid.column(v).drop_null().to_numpy()
            held[at[has], 1, day[has], i] = 1.0
        circle = circles.column("k").combine_chunks().dictionary_encode()
        which, keys = circle.indices.to_numpy(zero_copy_only=False), circle.dictionary
        to = np.searchsorted(cell, code(circles))
        to = np.where(cell[np.minimum(to, len(cell) - 1)] == code(circles), to, -1)
        radius, cover = circles.column("radius").to_numpy(), circles.column("cover").to_numpy()
        sums = np.zeros((len(reach), len(keys), 2, DAYS, count))
        for j, r in enumerate(reach):
            mine = np.flatnonzero((radius == r) & (to >= 0))
            mine = mine[np.lexsort((to[mine], which[mine]))]
            who = which[mine]
            nth = np.arange(len(who)) - np.searchsorted(who, who)  # a circle's first cells together, then its second ones
            for k in range(int(nth.max(initial=-1)) + 1):
                now = nth == k
                sums[j, who[now]] += held[to[mine[now]]] * cover[mine[now], None, None, None]
        total, weight = sums[:, :, 0], sums[:, :, 1]
        person, when = np.nonzero((weight > 0).any(axis=(0, 3)))
        first = int(circles.column("span")[0].as_py()) * DAYS
        out = {"key": keys.take(pa.array(person)), "date": pa.array((when + first).astype(np.int32), pa.date32())}
        for i, v in enumerate(values):
            for j, r in enumerate(reach):
                w, t = weight[j, person, when, i], total[j, person, when, i]
                out[f"{v}_{int(r)}"] = pa.array(np.divide(t, w, out=np.zeros(len(w)), where=w > 0), mask=w <= 0)
        return pa.table(out)

    by = ("tr", "tc", "part", "span")
    groups = (total["parts"] or 0) * spans.count()
    covers, c = (df.repartition(-(-groups // DAY_GROUPS) or 1, *by) for df in (covers, c))
    schema = f"key {kind}, date date, " + ", ".join(f"`{c}` double" for c in names)
    return covers.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(run, schema).withColumnRenamed("key", key)


def _wide_days(daily: DataFrame, values: Sequence[str]) -> DataFrame:
    """row, col, date and a column for each variable."""
    return daily.groupBy("row", "col", "date").agg(*[F.first(F.when(F.col("variable") == v, F.col("value")), ignorenulls=True).alias(v) for v in values])


def daily_wind(points: DataFrame, key: str, cells: DataFrame, frame: Frame, radius: float, coverage: str = "exact") -> DataFrame:
    """Speed and direction of each station and date, from the mean of each wind component around it."""
    parts = _wide_days(cells.filter(F.col("variable").isin("u10", "v10")), ["u10", "v10"])
    wide = zonal_days(points, key, [radius], parts, frame, ["u10", "v10"], coverage).withColumnsRenamed({f"{c}_{int(radius)}": c for c in ("u10", "v10")})
    return wide.withColumns(wind("u10", "v10"))


def building_density(points: DataFrame, key: str, cells: DataFrame, frame: Frame, radius: float, coverage: str = "exact") -> DataFrame:
    """Mean built-up share around each point and year, from yearly means of cells (row, col, year, value)."""
    yearly = cells.groupBy("row", "col", "year").agg(F.avg("value").alias("value"))
    return zonal_mean(points, key, [radius], yearly, frame, ["year"], coverage).withColumnRenamed("mean", "density").drop("radius")


def daily_weather(
    points: DataFrame, key: str, cells: DataFrame, frame: Frame, radii: Sequence[float], how: Mapping[str, str], kelvin: Sequence[str] = ("t2m",), hours: int = 9,
    coverage: str = "exact", days: DataFrame | None = None,
) -> DataFrame:
    """key, date and <variable>_<radius> columns: daily values around each station, kelvin as °C. days (date): those wanted, if not all."""
    daily = temporal_aggregate(cells, "ts", how, hours)
    if days is not None:
        daily = daily.join(small(days.select("date").distinct()), "date", "left_semi")
    out = zonal_days(points, key, radii, _wide_days(daily, list(how)), frame, list(how), coverage)
    return out.withColumns({f"{v}_{int(r)}": F.col(f"{v}_{int(r)}") - 273.15 for v in kelvin if v in how for r in radii})


def daily_aod(stays: DataFrame, key: str, cells: DataFrame, frame: Frame, radii: Sequence[float], coverage: str = "exact") -> DataFrame:
    """key, date, aod_<radius>: only stations that operate on the date; stays: key, x, y, date_start, date_end.

    Cells of dates on which no station operates are left out before any circle meets them.
    """
    places = stays.select(key, "x", "y").dropDuplicates([key])
    spans = stays.select(F.to_date("date_start").alias("a"), F.to_date("date_end").alias("z")).distinct().filter("a <= z")
    days = spans.select(F.explode(F.sequence("a", "z")).alias("date")).distinct()
    means = zonal_mean(places, key, radii, cells.join(small(days), "date", "left_semi"), frame, ["date"], coverage)
    during = interval_join(means, stays.select(key, "date_start", "date_end").withColumnRenamed(key, "_station"), key, site="_station", how="left_semi")
    return during.groupBy(key, "date").agg(*[F.first(F.when(F.col("radius") == float(r), F.col("mean")), ignorenulls=True).alias(f"aod_{int(r)}") for r in radii])
