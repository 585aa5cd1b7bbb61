"""Spatial joins and grids. Joins are equi-joins on coarse cells followed by exact tests, never all pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import direction_features, in_ring, planar_m, ring_meets_box, segment_m
from ..scratch import cut
from . import kernels, leaves
from .shapes import finite, points_within

#: Bandwidths beyond which a weight is 0 in double precision.
NOTHING_LEFT = {"gaussian": 38.7, "exponential": 745.2}
#: Pairs in neighbouring cells that are met one by one: so many a point, and in all.
PAIRS, FREE_PAIRS = 3000, 20_000_000


def cell_of(x, y, size: float) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def _spread(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def cover_box(df: DataFrame, xmin, ymin, xmax, ymax, size: float) -> DataFrame:
    """A row for each coarse cell that a box touches, as cell."""
    xs, ys = _spread(xmin, xmax, size), _spread(ymin, ymax, size)
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys)).withColumn("cell", F.struct("cx", "cy")).drop("cx", "cy")


def with_box(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polygons.withColumns({"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)})


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, keep: Sequence[str], how: str = "inner") -> DataFrame:
    """Points with the polygons (columns `keep`) that they are in; left_semi keeps points that are in any."""
    boxes = with_box(polygons)
    covered = cover_box(boxes.select(*keep, "ring", "xmin", "xmax", "ymin", "ymax"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    covered = covered.withColumnRenamed("cell", "_cell")
    inside = (
        (F.col("cell") == F.col("_cell"))
        & F.col("x").between(F.col("xmin"), F.col("xmax"))
        & F.col("y").between(F.col("ymin"), F.col("ymax"))
        & in_ring("x", "y", "ring")
    )
    joined = points.withColumn("cell", cell_of("x", "y", size)).join(covered, inside, how)
    return joined.drop("cell", "_cell", "ring", "xmin", "xmax", "ymin", "ymax")


def inside_region(points: DataFrame, region: DataFrame, size: float) -> DataFrame:
    """The points in any polygon of a region: rings (a column ring, of one ring each), or edges (feature, x1, y1, x2, y2) for any number of rings."""
    if "x1" in region.columns:
        return points_within(points, region, "feature", "left_semi")
    return points_in_polygons(points, region, size, [], "left_semi")


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, segment_id: str, leaf_rows: int = 64) -> DataFrame:
    """Each point with its nearest segment and the distance; ties go to the smaller segment id.

    Segments are dealt to leaves of about leaf_rows by a k-d tree of their middles, so that a dense town is as many leaves as it has segments; a point meets its own
    leaf and those that come as near as what it found there. Segments that lie on each other count as the one of the smallest id.
    Points without a finite place have no row; nor has any if there are no segments with finite ends. Of points with the same key one counts. points: key, x, y; segments:
    segment_id, x1, y1, x2, y2.
    """
    ends = ("x1", "y1", "x2", "y2")
    lines = segments.select(segment_id, *[F.col(c).cast("double").alias(c) for c in ends]).filter(finite(*ends))
    lines = lines.groupBy(*ends).agg(F.min(segment_id).alias(segment_id))
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    rows, tree = leaves.plant(lines, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, box, leaf_rows)
    asked = points.select(key, "x", "y").filter(finite("x", "y")).dropDuplicates([key])
    found = leaves.nearest(asked, key, rows, tree, segment_m("x", "y", *ends), segment_id)
    return found.select(key, segment_id, "distance")


def nearest_neighbours(stations: DataFrame, key: str, k: int = 5, leaf_rows: int = 64) -> DataFrame:
    """Each station's k nearest others with rank and distance; ties go to the smaller neighbour, unknown distances are last.

    A station looks at its own leaf and at those that come as near as its k-th there (as nearest_segment does). Of stations at one place only those of the k + 1 smallest
    ids can be neighbours. A station without a finite place is at an unknown distance from all, and a neighbour only where others are too few.
    """
    placed = finite("x", "y")
    at = stations.select(F.col(key).alias("neighbour"), F.col("x").cast("double").alias("nx"), F.col("y").cast("double").alias("ny"), placed.alias("_placed"))
    few = Window.partitionBy("nx", "ny").orderBy("neighbour")
    near = at.filter("_placed").withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= k + 1).select("neighbour", "nx", "ny")
    rows, tree = leaves.plant(near, F.col("nx"), F.col("ny"), [F.col("nx"), F.col("ny"), F.col("nx"), F.col("ny")], leaf_rows)
    a = stations.select(key, "x", "y")
    found = leaves.nearest(a.filter(placed), key, rows, tree, planar_m("x", "y", "nx", "ny"), "neighbour", k, F.col(key) != F.col("neighbour"))
    found = found.select(key, "neighbour", "distance")
    # those at an unknown distance: the smallest ids, k + 1 of each kind
    first = lambda which: [r[0] for r in at.filter(which).orderBy("neighbour").limit(k + 1).select("neighbour").collect()]
    if lost := first(~F.col("_placed")):
        some = first(F.col("_placed"))
        kind = f"array<{stations.schema[key].dataType.simpleString()}>"
        met = F.when(~placed, F.array(*map(F.lit, [*lost, *some])).cast(kind))
        met = met.otherwise(F.array(*map(F.lit, lost if len(some) <= k else [])).cast(kind))
        unknown = a.select(key, F.explode(met).alias("neighbour"), F.lit(None).cast("double").alias("distance"))
        found = found.unionByName(unknown.filter(F.col(key) != F.col("neighbour")))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("distance"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    b = stations.select(F.col(key).alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return a.join(ranked, key).join(b, "neighbour").select(key, "x", "y", "neighbour", "nx", "ny", "distance", "rank")


def neighbour_features(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(direction_features(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))


def kernel(name: str, d: Column, bw: float) -> Column:
    """Weight at a distance: gaussian and exponential reach on, tricube and epanechnikov end at bw."""
    u = d / F.lit(float(bw))
    if name == "gaussian":
        return F.exp(-u * u / 2) / F.lit(2.5066282746310002)
    if name == "exponential":
        return F.exp(-u)
    inside = d <= bw
    if name == "tricube":
        return F.when(inside, F.pow(1 - u * u * u, F.lit(3))).otherwise(0.0)
    if name == "epanechnikov":
        return F.when(inside, (1 - u * u) * 0.75).otherwise(0.0)
    raise ValueError(f"no kernel {name}")


def pair_sums(points: DataFrame, key: str, sources: DataFrame, reach: float, weight: Callable[[Column], Column]) -> DataFrame:
    """key, ew, w, least: sums over the sources (sx, sy, ew, xw: see merged_sources) within reach, found by cells of that size, and the least distance.

    Rows in cells are dealt to a fixed number of tasks: points take up to nine cells each, so they are never broadcast by the size they had before.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looked = cover_box(points, F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, reach).repartition(n, "cell")
    held = sources.withColumn("cell", cell_of("sx", "sy", reach)).repartition(n, "cell")
    pairs = looked.hint("shuffle_hash").join(held, "cell").withColumn("d", planar_m("x", "y", "sx", "sy")).filter(F.col("d") <= reach)
    pairs = pairs.withColumn("k", weight(F.col("d")))
    return pairs.groupBy(key).agg(F.sum(F.col("ew") * F.col("k")).alias("ew"), F.sum(F.col("xw") * F.col("k")).alias("w"), F.min("d").alias("least"))


def merged_sources(sources: DataFrame) -> DataFrame:
    """sx, sy, ew, xw: the sources (sx, sy, e, xw) of each place as one: the sums of their weights times values, and of the weights, where the value is known."""
    known = F.col("e").isNotNull()
    return sources.groupBy("sx", "sy").agg(F.sum(F.col("e") * F.col("xw")).alias("ew"), F.sum(F.when(known, F.col("xw"))).alias("xw"))


def cheapest_reach(points: DataFrame, sources: DataFrame, reaches: Sequence[float], pairs: float) -> float | None:
    """The largest of the reaches at which points and sources (sx, sy) in neighbouring cells of that size make so many pairs a point at most (and FREE_PAIRS).

    Pairs are counted from numbers of rows by cell, all reaches at once; None if even the smallest makes more.
    """
    sizes = F.array(*[F.lit(float(r)) for r in reaches])

    def counts(df: DataFrame, x: str, y: str) -> DataFrame:
        df = df.select(x, y, F.explode(sizes).alias("reach"))
        return df.groupBy("reach", *[F.floor(F.col(c) / F.col("reach")).alias(n) for c, n in ((x, "cx"), (y, "cy"))]).count()

    around = [F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c) for c in ("cx", "cy")]
    p = counts(points, "x", "y").withColumnRenamed("count", "np")
    p = p.select("reach", "np", "cy", around[0]).select("reach", "np", "cx", around[1])
    made = p.join(counts(sources, "sx", "sy"), ["reach", "cx", "cy"]).groupBy("reach").agg(F.sum(F.col("np").cast("double") * F.col("count")).alias("n"))
    most = pairs * points.count() + FREE_PAIRS
    over = {r["reach"] for r in made.collect() if r["n"] > most}
    return max((r for r in map(float, reaches) if r not in over), default=None)


def _endless_sums(points: DataFrame, key: str, sources: DataFrame, bw: float, name: str) -> DataFrame:
    """key, ew, w, least for the points that have a source within bw: all sources count.

    Where few sources are in reach of a weight above 0 (in double precision), they are met in pairs. Else the nearest source is looked up by leaves, and sums go by
    cells; for the exponential kernel pairs within a smaller reach (chosen by their number) add what those leave. Points whose sums are small beside what lies far away,
    so that rounding could show, meet their sources in pairs too.
    """
    sources, points = cut(sources), cut(points)
    exact = lambda p: pair_sums(p, key, sources, NOTHING_LEFT[name] * bw, lambda d: kernel(name, d, bw))
    reaches = [bw * r for r in (NOTHING_LEFT[name], *(2.0**i for i in range(5, -4, -1) if name == "exponential"))]
    reach = cheapest_reach(points, sources, reaches, PAIRS)
    if reach == reaches[0]:
        return exact(points)
    at = sources.select("sx", "sy", F.lit(0).alias("_s"))
    rows, tree = leaves.plant(at, F.col("sx"), F.col("sy"), [F.col("sx"), F.col("sy"), F.col("sx"), F.col("sy")])
    near = leaves.nearest(points.dropDuplicates([key]), key, rows, tree, planar_m("x", "y", "sx", "sy"), "_s").filter(F.col("distance") <= bw)
    near = cut(near.select(key, F.col("distance").alias("least")).join(points.hint("merge"), key))
    weighed = sources.select(F.col("sx").alias("x"), F.col("sy").alias("y"), *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("ew", "ew"), ("xw", "w"))])
    reach = reach or min(reaches)
    parts = kernels.gaussian_parts(bw) if name == "gaussian" else kernels.exponential_parts(bw, reach / bw)
    sums = kernels.kernel_sums(near, key, weighed, parts)
    if name == "exponential":
        left = pair_sums(near, key, sources, reach, lambda d: kernels.left_of_sum(d, bw, parts)).select(key, F.col("ew").alias("ew2"), F.col("w").alias("w2"))
        sums = sums.join(left, key, "left").withColumns({c: F.col(c) + F.coalesce(f"{c}2", F.lit(0.0)) for c in ("ew", "w")}).drop("ew2", "w2")
    sums = cut(near.select(key, "least").join(sums.hint("merge"), key))
    noisy = lambda c: F.col(f"{c}_noise") * kernels.NOISE > F.abs(c) * kernels.TOLERANCE
    unsure = sums.filter(noisy("ew") | noisy("w")).select(key)
    sums = sums.select(key, "ew", "w", "least")
    if unsure.isEmpty():
        return sums
    return sums.join(unsure, key, "left_anti").unionByName(exact(near.join(unsure, key, "left_semi")))


def kernel_sources(
    points: DataFrame, sources: DataFrame, key: str, bw: float, name: str = "gaussian", value: str = "emission",
    weight: str | None = None, truncate: bool = False, empty: float | None = None, clip: DataFrame | None = None,
) -> DataFrame:
    """key and the kernel-weighted mean of the sources around each point.

    With truncate, and for kernels that end at bw, sources within bw count, found by cells of that size. Otherwise all
    sources count where at least one is within bw: by sums over cells (kernels.kernel_sums), which differ from those over pairs by 1e-10 at most. Points without a
    source, outside the clip polygons, or with weights that sum to 0, get `empty`; sources outside them don't count, nor do sources without a finite place. A null value has no weight,
    but its source may be the one within bw. Sources of one place act as one and points of one place are looked up once, so that work goes by places.
    """
    if value not in sources.columns:
        raise ValueError(f"sources have no column {value}")
    extra = F.col(weight) if weight else F.lit(1.0)
    s = sources.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(value).cast("double").alias("e"), extra.cast("double").alias("xw"))
    if weight:
        s = s.filter(F.when(F.col("xw").isNull() | (F.col("xw") < 0), F.raise_error(F.lit("weights must be known and not negative"))).otherwise(True))
    p = points.select(key, "x", "y")
    used = inside_region(p, clip, bw) if clip is not None else p
    if clip is not None:
        s = inside_region(s.withColumnsRenamed({"sx": "x", "sy": "y"}), clip, bw).withColumnsRenamed({"x": "sx", "y": "sy"})
    used, s = used.filter(finite("x", "y")), merged_sources(s.filter(finite("sx", "sy")))
    place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = used.select("x", "y").distinct().withColumn("_place", place)
    if truncate or name in ("tricube", "epanechnikov"):
        sums = pair_sums(places, "_place", s, bw, lambda d: kernel(name, d, bw))
    else:
        sums = _endless_sums(places, "_place", s, bw, name)
    mean = F.when(F.col("least") <= bw, F.col("ew") / F.nullif(F.col("w"), F.lit(0.0)))
    out = p.withColumn("_place", place).join(sums.hint("merge"), "_place", "left").select(key, mean.alias(value))
    return out.fillna(empty, [value]) if empty is not None else out


def padded_grid(extent: DataFrame, size: float, chunks: int) -> DataFrame:
    """cell_id, row, col, xmin, ymin, xmax, ymax: square cells over an extent padded to whole chunks.

    extent: one row of xmin, ymin, xmax, ymax. Its floor is widened by ten cells on the low side and by the rest of a
    chunk, less those ten cells, on the high side.
    """
    chunk = float(size * chunks)
    ends = {}
    for a in ("x", "y"):
        lo, hi = F.floor(f"{a}min"), F.floor(f"{a}max")
        rest = F.lit(chunk) - F.pmod((hi - lo).cast("double"), F.lit(chunk))
        ends[f"{a}0"], ends[f"{a}1"] = lo - F.lit(10.0 * size), hi + rest - F.lit(10.0 * size)
    e = extent.select(*[v.alias(k) for k, v in ends.items()])
    nx, ny = F.round((F.col("x1") - F.col("x0")) / size).cast("int"), F.round((F.col("y1") - F.col("y0")) / size).cast("int")
    cells = e.withColumn("row", F.explode(F.sequence(F.lit(0), ny - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), nx - 1)))
    x, y = F.col("x0") + F.col("col") * F.lit(size), F.col("y0") + F.col("row") * F.lit(size)
    return cells.select(
        F.concat_ws("_", "row", "col").alias("cell_id"), "row", "col", x.alias("xmin"), y.alias("ymin"), (x + size).alias("xmax"), (y + size).alias("ymax")
    )


def auto_grid(extent: DataFrame, size: float, chunks: int, region: DataFrame | None = None) -> DataFrame:
    """cell_id, row, col, xmin, ymin, xmax, ymax: chunks by chunks cells over the padded extent, those that meet the region.

    The extent is padded as in padded_grid. region: polygons with a ring; cells that only touch one meet it. Without a region all stay.
    """
    p = padded_grid(extent, size, chunks).agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1"))
    p = p.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    w, h = (F.col("x1") - F.col("x0")) / chunks, (F.col("y1") - F.col("y0")) / chunks
    x, y = F.col("x0") + F.col("col") * w, F.col("y0") + F.col("row") * h
    cells = p.select(F.concat_ws("_", "row", "col").alias("cell_id"), "row", "col", x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))
    if region is None:
        return cells
    return cells.join(region.select("ring"), ring_meets_box("ring", "xmin", "ymin", "xmax", "ymax"), "left_semi")


def split_extent(extent: DataFrame, nx: int, ny: int, padding: float = 0.0) -> DataFrame:
    """part, xmin, ymin, xmax, ymax: nx by ny parts, each widened by the padding."""
    p = extent.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    w, h = (F.col("xmax") - F.col("xmin")) / nx, (F.col("ymax") - F.col("ymin")) / ny
    x, y = F.col("xmin") + F.col("i") * w, F.col("ymin") + F.col("j") * h
    return p.select(
        (F.col("j") * nx + F.col("i")).alias("part"), (x - padding).alias("xmin"), (y - padding).alias("ymin"), (x + w + padding).alias("xmax"), (y + h + padding).alias("ymax")
    )


def point_grid(spark, xmin: float, ymin: float, xmax: float, ymax: float, step: float) -> DataFrame:
    """gid, x, y of cell centres; gid is made of row and column."""
    nx, ny = int((xmax - xmin) // step), int((ymax - ymin) // step)
    rows = spark.range(ny).withColumnRenamed("id", "row").withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return rows.select(
        F.concat_ws("_", "row", "col").alias("gid"), (F.lit(xmin + step / 2) + F.col("col") * step).alias("x"), (F.lit(ymin + step / 2) + F.col("row") * step).alias("y")
    )


def random_points(spark, n: int, xmin: float, ymin: float, xmax: float, ymax: float, seed: int = 1, inside: DataFrame | None = None, size: float = 1000.0) -> DataFrame:
    """Reproducible points of a box, or those of them in polygons: their places are drawn by their number."""

    def share(salt: int) -> Column:
        text = F.concat(F.lit(f"{seed}.{salt}:"), F.col("id").cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))

    p = spark.range(n).select("id", (F.lit(xmin) + share(1) * (xmax - xmin)).alias("x"), (F.lit(ymin) + share(2) * (ymax - ymin)).alias("y"))
    return inside_region(p, inside, size) if inside is not None else p
