"""Queries on rasters as blocks; their SQL is that of the same operators on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from . import spatial_queries as cells
from .tables import Tables

Q: dict = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def _grid(t: Tables, tile: int) -> B.Grid:
    """The land-use raster's: 50 columns, and as many rows as there are."""
    return B.Grid(tile, t.landuse.agg(F.max("row")).first()[0] + 1, 50)


def _present(t: Tables, out):
    """Only cells that the table has; blocks are full squares. The raster is never broadcast."""
    return out.join(t.landuse.select("row", "col").hint("merge"), ["row", "col"], "left_semi")


def _fractions(t: Tables, tile: int, **how):
    grid = _grid(t, tile)
    blocks = B.to_blocks(t.landuse, grid, "class", "i2")
    out = B.to_cells(B.focal_fractions(blocks, grid, cells.CLASSES, 3, kind="f8", **how), grid, "fraction")
    return _present(t, out).select("row", "col", F.substring("band", 7, 2).cast("int").alias("class"), F.round("fraction", 6).alias("fraction"))


@query(cells._focal_sql("a * a + b * b <= 9"))
def block_focal_fraction(t: Tables):
    return _fractions(t, 16)


@query(cells._focal_sql("a * a + b * b <= 12.25"))
def block_focal_wide(t: Tables):
    """Blocks smaller than the neighbourhood: borders come from beyond the next block."""
    return _fractions(t, 2, shape="wide")


@query(cells._focal_sql("TRUE", "49"))
def block_focal_kernel_square(t: Tables):
    return _fractions(t, 32, shape="square", denom="kernel")


@query(
    """WITH o AS (SELECT a::INT AS dr, b::INT AS dc FROM range(-2, 3) x(a), range(-2, 3) y(b)),
    s AS (SELECT l.row - o.dr AS row, l.col - o.dc AS col, avg(value) AS m FROM {landuse} l, o GROUP BY 1, 2)
    SELECT row, col, round(m, 6) AS mean FROM {landuse} LEFT JOIN s USING (row, col)"""
)
def block_focal_mean(t: Tables):
    grid = _grid(t, 16)
    out = B.to_cells(B.focal_mean(B.to_blocks(t.landuse, grid), grid, 2), grid, "mean")
    return _present(t, out).select("row", "col", F.round("mean", 6).alias("mean"))


@query(cells.Q["lower_filter"][1])
def block_lower_filter(t: Tables):
    grid = _grid(t, 16)
    out = B.to_cells(B.lower_share(B.to_blocks(t.landuse, grid), grid, 2), grid, "higher")
    return _present(t, out).select("row", "col", "higher")


@query(cells.Q["block_aggregate"][1])
def block_means(t: Tables):
    grid = _grid(t, 44)
    coarse, small = B.coarsen(B.to_blocks(t.landuse, grid), grid, 11)
    return B.to_cells(coarse, small).filter(F.col("value").isNotNull()).select("row", "col", "value")


@query("SELECT row, col, round(exp((dsm - dem) / 10) * mtpi, 6) AS value FROM {terrain}")
def block_algebra(t: Tables):
    """Whole arrays of three bands at a time."""
    import numpy as np

    grid = _grid(t, 16)
    bands = {name: B.to_blocks(t.terrain, grid, name) for name in ("dsm", "dem", "mtpi")}
    out = B.to_cells(B.algebra(bands, grid, lambda dsm, dem, mtpi: np.exp((dsm - dem) / 10) * mtpi), grid)
    return _present(t, out).select("row", "col", F.round("value", 6).alias("value"))
