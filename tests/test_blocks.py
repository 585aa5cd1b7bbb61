"""Rasters as blocks, against whole arrays in NumPy and the operators on cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import blocks as B
from aerogrid.operators import raster as R


def cells(spark, grid):
    rows = [(r, c, None if np.isnan(v) else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def whole(blocks, grid, band=None):
    """A band's blocks as one array."""
    out = np.full((-(-grid.rows // grid.tile) * grid.tile, -(-grid.cols // grid.tile) * grid.tile), np.nan)
    for b in blocks.filter(F.col("band") == band if band else F.lit(True)).collect():
        a = np.frombuffer(bytes(b["data"]), f"<{b['kind']}").reshape(grid.tile, grid.tile).astype(float)
        if b["kind"][0] == "i":
            a[a == B.MISSING[b["kind"]]] = np.nan
        out[b["tr"] * grid.tile : (b["tr"] + 1) * grid.tile, b["tc"] * grid.tile : (b["tc"] + 1) * grid.tile] = a
    assert np.isnan(out[grid.rows :]).all() and np.isnan(out[:, grid.cols :]).all()
    return out[: grid.rows, : grid.cols]


def neighbourhood(a, r, shape):
    """Values of the kernel around each cell: an array for each offset."""
    wide = np.full((a.shape[0] + 2 * r, a.shape[1] + 2 * r), np.nan)
    wide[r : r + a.shape[0], r : r + a.shape[1]] = a
    return np.array([wide[r + d : r + d + a.shape[0], r + c : r + c + a.shape[1]] for d, h in R.kernel_rows(r, shape) for c in range(-h, h + 1)])


@pytest.fixture(scope="module")
def land():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, (43, 31)).astype(float)
    a[rng.random(a.shape) < 0.1] = np.nan
    a[10:30, 5:25] = np.nan
    return a


@pytest.mark.parametrize("kind", ["i2", "i4", "f4", "f8"])
def test_round_trip(spark, land, kind):
    grid = B.Grid(8, *land.shape)
    out = whole(B.to_blocks(cells(spark, land), grid, kind=kind), grid)
    assert np.array_equal(out, land, equal_nan=True)
    back = {(r["row"], r["col"]): r["value"] for r in B.to_cells(B.to_blocks(cells(spark, land), grid, kind=kind), grid).collect()}
    assert len(back) == land.size
    assert all((v is None and np.isnan(land[k])) or v == land[k] for k, v in back.items())


def test_odd_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 0, None), (0, 1, 2.0), (None, 1, 9.0), (9, 0, 9.0), (-1, 0, 9.0), (1, 1, None)], "row int, col int, value double")
    grid = B.Grid(4, 2, 2)
    got = {(r["row"], r["col"]): r["value"] for r in B.to_cells(B.to_blocks(df, grid), grid).collect()}
    assert got == {(0, 0): 3.0, (0, 1): 2.0, (1, 0): None, (1, 1): None}
    assert B.to_blocks(df.limit(0), grid).count() == 0
    assert B.focal_fractions(B.to_blocks(df.limit(0), grid), grid, [1], 1).count() == 0


@pytest.mark.parametrize("shape", ["disk", "square", "wide", "mask"])
@pytest.mark.parametrize("radius", [1, 2, 5, 9])
def test_sums_of_kernels(shape, radius):
    rng = np.random.default_rng(radius)
    tile, kernel = 12, B.Kernel(radius, shape)
    a = rng.integers(0, 2, (tile + 2 * radius,) * 2)
    want = neighbourhood(a.astype(float), radius, shape)[:, radius:-radius, radius:-radius].sum(0)
    assert np.array_equal(kernel.sums(a.astype("u2"), tile), want) and kernel.size == len(neighbourhood(a, radius, shape))


def test_sums_that_wrap_round():
    """Corner sums go far beyond 16 bits; what is left in the end doesn't."""
    kernel, tile = B.Kernel(140, "disk"), 64
    assert kernel.whole() == "u2" and B.Kernel(150, "disk").whole() == "u4"
    assert (kernel.sums(np.ones((tile + 280,) * 2, "u2"), tile) == kernel.size).all()
    assert len(kernel.rows) + len(kernel.cols) < 1.3 * 140


@pytest.mark.parametrize("tile, radius, shape, denom", [(8, 3, "disk", "valid"), (16, 5, "wide", "kernel"), (4, 9, "disk", "valid"), (64, 2, "square", "valid"), (7, 3, "mask", "kernel")])
def test_fractions(spark, land, tile, radius, shape, denom):
    grid = B.Grid(tile, *land.shape)
    out = B.focal_fractions(B.to_blocks(cells(spark, land), grid, kind="i2"), grid, [0, 3, 7], radius, shape, denom, kind="f8").persist()
    near = neighbourhood(land, radius, shape)
    n = (~np.isnan(near)).sum(0)
    for k in (0, 3, 7):
        want = np.where(n > 0, (near == k).sum(0) / (np.maximum(n, 1) if denom == "valid" else len(near)), 0.0)
        # blocks without any value have no row
        got = whole(out, grid, B.class_name(k))
        assert np.array_equal(got, np.where(np.isnan(got), np.nan, want), equal_nan=True)
        assert not np.isnan(got[~np.isnan(land)]).any()
    out.unpersist()


def test_fractions_are_those_of_cells(spark, land):
    grid = B.Grid(10, *land.shape)
    df = cells(spark, land)
    for how in ({"empty": None}, {"border": "zero"}, {"shape": "wide", "denom": "kernel"}):
        size = {"size": land.shape} if "border" in how else {}
        a = R.focal_class_fraction(df.withColumnRenamed("value", "class"), [1, 2], 3, tile=16, **how, **size)
        b = B.to_cells(B.focal_fractions(B.to_blocks(df, grid, kind="i2"), grid, [1, 2], 3, kind="f8", **how), grid, "fraction")
        a = {(r["row"], r["col"], r["class"]): r["fraction"] for r in a.collect()}
        b = {(r["row"], r["col"], int(r["band"][6:])): r["fraction"] for r in b.collect()}
        assert all(b.get(k) == v or (v in (None, 0.0) and k not in b) for k, v in a.items()), how


def test_only_borders_are_sent(spark, land):
    grid = B.Grid(16, *land.shape)
    sent = B.border_strips(B.to_blocks(cells(spark, np.nan_to_num(land)), grid, kind="i2"), grid, 2).agg(F.sum(F.length("data"))).first()[0]
    # 3 x 2 blocks: 7 borders between blocks that touch along a side (twice 16 x 2 cells), and 4 pairs that touch at a corner (twice 2 x 2)
    assert sent == 2 * (7 * 2 * 16 * 2 + 4 * 2 * 2 * 2)


def test_means_and_the_ring(spark, land):
    grid, df = B.Grid(9, *land.shape), cells(spark, land)
    with np.errstate(invalid="ignore"), pytest.warns(RuntimeWarning):
        want = np.nanmean(neighbourhood(land, 2, "square"), axis=0)
    got = whole(B.focal_mean(B.to_blocks(df, grid), grid, 2), grid)
    assert np.allclose(got[~np.isnan(got)], want[~np.isnan(got)]) and not np.isnan(got[~np.isnan(land)]).any()
    a = {(r["row"], r["col"]): r["higher"] for r in R.lower_filter(df, 2).collect()}
    got = whole(B.lower_share(B.to_blocks(df, grid), grid, 2), grid)
    assert all(got[k] == v for k, v in a.items() if not np.isnan(land[k]))


def test_coarser_blocks(spark, land):
    df = cells(spark, land)
    for edge, factor in (("keep", 4), ("truncate", 4)):
        grid = B.Grid(12, *land.shape)
        out, small = B.coarsen(B.to_blocks(df, grid), grid, factor, edge)
        got = {(r["row"], r["col"]): r["value"] for r in B.to_cells(out, small).filter("value IS NOT NULL").collect()}
        want = {(r["row"], r["col"]): r["value"] for r in R.block_aggregate(df, factor, edge, land.shape).filter("value IS NOT NULL").collect()}
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        B.coarsen(df, B.Grid(10, 9, 9), 4)


def test_algebra(spark, land):
    grid = B.Grid(16, *land.shape)
    a, b = B.to_blocks(cells(spark, land), grid, kind="i2"), B.to_blocks(cells(spark, land * 2).filter("row < 16"), grid)
    got = whole(B.algebra({"a": a, "b": b}, grid, lambda a, b: b - a), grid)
    assert np.array_equal(got[:16], land[:16], equal_nan=True) and np.isnan(got[16:]).all()
    full = whole(B.algebra({"a": a, "b": b}, grid, lambda a, b: np.where(np.isnan(b), a, b), how="full"), grid)
    assert np.array_equal(full, np.where(np.arange(43)[:, None] < 16, land * 2, land), equal_nan=True)


def test_small_blocks_go_by_regions(spark):
    """Work goes by cells: blocks of 2 x 2 are looked at many at a time, and give only what lies at the borders of regions."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (300, 140)).astype(float)
    a[rng.random(a.shape) < 0.1] = np.nan
    a[40:90, 20:60] = np.nan
    grid = B.Grid(2, *a.shape)
    blocks = B.to_blocks(cells(spark, a), grid, kind="i2")
    assert B.border_strips(blocks, grid, 3, grid.regions()).count() < blocks.count() / 8
    sides = whole(B.focal(blocks, grid, 1, lambda wide, band: [(band, np.full((len(wide) - 2,) * 2, len(wide) - 2.0))], "f8"), grid)
    assert set(sides[~np.isnan(sides)]) == {128.0}
    got = whole(B.focal_fractions(blocks, grid, [1], 3, "wide", kind="f8"), grid, "class_01")
    around = neighbourhood(a, 3, "wide")
    known = (~np.isnan(around)).sum(0)
    want = np.where(known > 0, (around == 1).sum(0) / np.maximum(known, 1), 0.0)
    there = ~np.isnan(got)
    assert np.allclose(got[there], want[there]) and there[~np.isnan(a)].all()


def test_blocks_are_taken_few_at_a_time():
    import pyarrow as pa

    data = np.zeros((44, 44)).tobytes()
    batch = pa.RecordBatch.from_pylist([{"tr": i, "tc": 0, "band": "v", "kind": ("f8", "f4")[i % 2], "data": data[: len(data) // (1 + i % 2)]} for i in range(500)])
    stacks = list(B._stacks(iter([batch]), 44))
    assert max(a.size for *_, a in stacks) <= B.HELD and sorted(r for _, tr, *_ in stacks for r in tr) == list(range(500))
