import math

import numpy as np
import pytest

from aerogrid.functions import geometry as G
from aerogrid.operators import raster as R
from pyspark.sql import functions as F


def cells(spark, grid, nodata=-9999):
    rows = [(r, c, None if v == nodata else v) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, class int")


def fraction(df, row, col, k):
    return df.filter((F.col("row") == row) & (F.col("col") == col) & (F.col("class") == k)).first()["fraction"]


def around(grid, row, col, r, nodata=-9999):
    """The known classes in a disk, cell by cell."""
    near = [(i, j) for i in range(len(grid)) for j in range(len(grid[0])) if (i - row) ** 2 + (j - col) ** 2 <= r * r]
    return [grid[i][j] for i, j in near if grid[i][j] != nodata]


@pytest.mark.parametrize("seed, rows, cols, r", [(1, 6, 9, 1), (2, 7, 7, 2), (3, 11, 5, 4)])
def test_fractions_cell_by_cell(spark, seed, rows, cols, r):
    grid = np.random.default_rng(seed).choice([3, 4, 8, -9999], (rows, cols), p=[0.4, 0.3, 0.2, 0.1]).tolist()
    got = {(x["row"], x["col"], x["class"]): x["fraction"] for x in R.focal_class_fraction(cells(spark, grid), [3, 4, 8], r, tile=4).collect()}
    assert len(got) == rows * cols * 3
    for (i, j, k), f in got.items():
        held = around(grid, i, j, r)
        assert f == pytest.approx(held.count(k) / len(held) if held else 0.0)


def test_classes_that_occur(spark):
    got = R.distinct_classes(cells(spark, [[7, -9999, 5, 5], [9, 7, -9999, 5]]), nodata=9)
    assert [r["class"] for r in got.collect()] == [5, 7]


def test_tiles_read_their_halo(spark):
    width, tile, pad = 23, 7, 2
    df = spark.range(width * 9).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    got = {(r["tr"], r["tc"]): r["n"] for r in R.with_halo(df, tile, pad).groupBy("tr", "tc").count().withColumnRenamed("count", "n").collect()}
    inside = lambda at, n: [t for t in range(n) if at * tile - pad <= t < (at + 1) * tile + pad]
    for (tr, tc), n in got.items():
        assert n == len(inside(tr, 9)) * len(inside(tc, width))
    assert {(tr, tc) for tr in range(2) for tc in range(4)} <= set(got)


@pytest.mark.parametrize("shape, inside", [
    ("disk", lambda a, b, r: a * a + b * b <= r * r), ("square", lambda a, b, r: True), ("wide", lambda a, b, r: a * a + b * b <= (r + 0.5) ** 2),
    ("mask", lambda a, b, r: a * a + b * b <= r * r or max(abs(a), abs(b)) == r and min(abs(a), abs(b)) == 1), ("ring", lambda a, b, r: max(abs(a), abs(b)) == r),
])
def test_kernels_cell_by_cell(spark, shape, inside):
    for r in (1, 3, 6):
        got = {(x["dr"], x["dc"]) for x in R.kernel_offsets(spark, r, shape).collect()}
        assert got == {(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if inside(a, b, r)}


def test_blocks_that_the_edge_cuts(spark):
    df = spark.range(35).select((F.col("id") / 7).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    assert R.block_aggregate(df, 3).count() == 6
    kept = {(r["row"], r["col"]): r["value"] for r in R.block_aggregate(df, 3, "truncate", (5, 7)).collect()}
    assert kept == {(0, c): sum(7 * i + j for i in range(3) for j in range(3 * c, 3 * c + 3)) / 9 for c in (0, 1)}


def test_radius_in_cells():
    assert R.radius_cells(2000, 30, True) == 67
    assert R.radius_cells(67, 30, False) == 67


def test_tiling_changes_nothing(spark):
    rng = np.random.default_rng(3)
    df = cells(spark, rng.integers(0, 4, (37, 41)).tolist(), nodata=0)
    key = lambda d: sorted((r["row"], r["col"], r["class"], round(r["fraction"], 9)) for r in d.collect())
    for shape in ("disk", "square"):
        a = key(R.focal_class_fraction(df, [1, 2, 3], 4, shape, tile=8))
        assert a == key(R.focal_class_fraction(df, [1, 2, 3], 4, shape, tile=64))
    assert key(R.focal_class_fraction(df, [1, 2, 3], 4, tile=16)) == key(R.focal_fraction_join(df, R.kernel_offsets(spark, 4), [1, 2, 3]))


def test_empty_and_border_options(spark):
    df = cells(spark, [[-9999, -9999, -9999], [-9999, -9999, -9999], [-9999, -9999, 1]])
    assert fraction(R.focal_class_fraction(df, [1], 1), 0, 0, 1) == 0.0
    assert fraction(R.focal_class_fraction(df, [1], 1, empty=None), 0, 0, 1) is None
    assert fraction(R.focal_class_fraction(df, [1], 1, border="zero", size=(3, 3)), 2, 2, 1) == 0.0


def test_fractions_sum_to_one(spark):
    pts = spark.createDataFrame([(1, 55.0, 45.0)], "pid long, x double, y double")
    rows = [(r, c, (r + c) % 3) for r in range(10) for c in range(10)]
    land = spark.createDataFrame(rows, "row int, col int, class int")
    got = R.zonal_fraction(pts, "pid", [25], land, R.Frame(0, 100, 10, 10), [0, 1, 2]).first()
    assert sum(got[f"landuse_frac_{k}_25"] for k in range(3)) == pytest.approx(1.0)


def test_circle_cover_is_the_circle(spark):
    pts = spark.createDataFrame([(1, 52.3, 47.1), (2, 50.0, 50.0)], "pid long, x double, y double")
    cover = R.buffer_cells(pts, "pid", [7, 23], R.Frame(0, 100, 10, 10))
    for r in cover.groupBy("pid", "radius").agg(F.sum("cover").alias("s")).collect():
        assert r["s"] * 100 == pytest.approx(math.pi * r["radius"] ** 2, rel=1e-9)


@pytest.mark.parametrize("coverage", ["exact", "centre"])
def test_runs_and_cut_cells_are_the_circle_s_cells(spark, coverage):
    rng = np.random.default_rng(9)
    rows = [(r, c, float(rng.integers(0, 50)) if rng.random() > 0.1 else None, int(rng.integers(0, 2)), int(rng.integers(0, 3))) for r in range(60) for c in range(150) if rng.random() > 0.05]
    df = spark.createDataFrame(rows, "row int, col int, value double, t int, class int")
    pts = spark.createDataFrame([(i, float(rng.uniform(-20, 1500)), float(rng.uniform(0, 900))) for i in range(12)] + [(50, 755.0, 300.0), (51, None, 1.0)], "pid int, x double, y double")
    frame, radii = R.Frame(0.0, 900.0, 10.0, 15.0), [4, 90, 700]
    held = R.buffer_cells(pts, "pid", radii, frame, coverage).join(df.filter("value IS NOT NULL"), ["row", "col"])
    want = {(r["pid"], r["radius"], r["t"]): (r["m"], r["w"]) for r in held.groupBy("pid", "radius", "t").agg((F.sum(F.col("value") * F.col("cover")) / F.sum("cover")).alias("m"), F.sum("cover").alias("w")).collect()}
    sums = {(r["pid"], r["radius"], r["t"]): (r["total"] / r["weight"], r["weight"]) for r in R.zonal_sums(pts, "pid", radii, df, frame, ["t"], coverage).collect()}
    assert set(sums) == set(want)
    for k, (m, w) in want.items():
        assert sums[k] == (pytest.approx(m), pytest.approx(w)), k
    pieces = R.circle_pieces(pts, "pid", radii, frame, coverage)
    assert pieces.count() < 0.25 * R.buffer_cells(pts, "pid", radii, frame, coverage).count()
    got = {(r["pid"], k, q): r[f"landuse_frac_{k}_{q}"] for r in R.zonal_fraction(pts, "pid", radii, df.drop("value"), frame, [0, 1, 2], coverage=coverage).collect() for k in range(3) for q in radii}
    all_ = R.buffer_cells(pts, "pid", radii, frame, coverage).join(df, ["row", "col"]).toPandas()
    for (pid, k, q), f in got.items():
        mine = all_[(all_["pid"] == pid) & (all_["radius"] == q)]
        assert f == pytest.approx(mine[mine["class"] == k]["cover"].sum() / mine["cover"].sum() if len(mine) else 0.0)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(127.5, 38.0), (126.0, 34.0), (129.3, 36.6)], "lon double, lat double")
    for grid in G.GRIDS.values():
        p = df.select("lon", "lat", G.project_tm("lon", "lat", grid).alias("p")).select("lon", "lat", "p.x", "p.y", G.unproject_tm("p.x", "p.y", grid).alias("q"))
        for r in p.collect():
            assert (r["q"]["lon"], r["q"]["lat"]) == (pytest.approx(r["lon"], abs=1e-8), pytest.approx(r["lat"], abs=1e-8))
    origin = df.select(G.project_tm("lon", "lat").alias("p")).first()["p"]
    assert (origin["x"], origin["y"]) == (pytest.approx(1_000_000), pytest.approx(2_000_000))


def test_ellipsoid_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(G.ellipsoid_m("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(111319.491, abs=0.01)
    assert got[1] == 0.0
