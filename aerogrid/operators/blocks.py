"""Rasters as blocks: a table (tr, tc, band, kind, data) of square arrays, beside the table of cells.

A block holds tile x tile values, row by row and little-endian. Neighbourhoods get their borders from the blocks around: only strips of the width
that a neighbour needs are sent. What is computed stays an array, one block a band, until cells are asked for. Small blocks are made and
looked at many at a time, by regions of them, so that work goes by cells and not by blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .raster import kernel_rows

BLOCKS = "tr int, tc int, band string, kind string, data binary"
_STRIPS = "rr int, rc int, band string, kind string, top int, left int, height int, width int, data binary"
#: The side of a region, in cells, unless one block is larger; and cells that a task turns into rows, or arrays, at a time.
SPAN, HELD = 128, 1 << 16
#: Kinds of values, and the value that stands for a missing one.
MISSING = {"f8": np.nan, "f4": np.nan, "i4": np.iinfo("i4").min, "i2": np.iinfo("i2").min}


class Grid(NamedTuple):
    """The side of a block, and the raster's rows and columns; beyond these a block holds missing values."""

    tile: int
    rows: int
    cols: int

    def inside(self, tr: int, tc: int) -> bool:
        return 0 <= tr * self.tile < self.rows and 0 <= tc * self.tile < self.cols

    def regions(self) -> Grid:
        """The grid whose blocks are the regions: so many whole blocks as make SPAN cells a side, one at least."""
        return self._replace(tile=max(1, SPAN // self.tile) * self.tile)

    def in_regions(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the region, rr and rc, that holds them."""
        return blocks.withColumns({f"r{c}": F.floor(F.col(f"t{c}") * self.tile / self.regions().tile).cast("int") for c in "rc"})


def known(a: np.ndarray) -> np.ndarray:
    """Where an array has a value."""
    return ~np.isnan(a) if a.dtype.kind == "f" else a != np.iinfo(a.dtype).min


def _array(data: bytes, kind: str, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").reshape(shape)


def _pack(a: np.ndarray, kind: str) -> bytes:
    """An array's bytes in a kind; missing values of another kind become that of this one."""
    if a.dtype.str[1:] != kind:
        with np.errstate(invalid="ignore"):
            a = np.where(known(a), a.astype(f"<{kind}"), np.array(MISSING[kind], f"<{kind}"))
    return np.ascontiguousarray(a, f"<{kind}").tobytes()


def _rows(rows: list[tuple], schema: Sequence[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table({name: pa.array(c, t) for c, (name, t) in zip(cols, schema, strict=True)})


_BLOCK = [("tr", pa.int32()), ("tc", pa.int32()), ("band", pa.string()), ("kind", pa.string()), ("data", pa.binary())]
_STRIP = [("rr", pa.int32()), ("rc", pa.int32()), *_BLOCK[2:4], *((n, pa.int32()) for n in ("top", "left", "height", "width")), _BLOCK[4]]


def _blobs(arrays: np.ndarray, kind: str) -> pa.Array:
    """The bytes of each of a stack of arrays, in a kind."""
    data, size = _pack(arrays, kind), arrays[0].size * np.dtype(kind).itemsize if len(arrays) else 0
    if len(data) >= 1 << 31:
        raise ValueError(f"{len(arrays)} blocks of {size} bytes are too many at once")
    return pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(np.arange(len(arrays) + 1, dtype="i4") * size), pa.py_buffer(data)])


def _table(tr: np.ndarray, tc: np.ndarray, band: Sequence[str], kind: str, arrays: np.ndarray) -> pa.Table:
    """Blocks of a stack of arrays."""
    cols = [pa.array(tr, pa.int32()), pa.array(tc, pa.int32()), pa.array(band, pa.string()), pa.array([kind] * len(arrays), pa.string()), _blobs(arrays, kind)]
    return pa.table(dict(zip([n for n, _ in _BLOCK], cols, strict=True)))


def _slices(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[list[dict]]:
    """Rows of the batches, of about HELD cells at a time: a batch may hold ten thousand blocks."""
    n = max(1, HELD // tile**2)
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n).to_pylist()


def _stacks(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(kind, tr, tc, bands, arrays) of blocks of one kind, about HELD cells at a time."""
    for rows in _slices(batches, tile):
        for kind in dict.fromkeys(b["kind"] for b in rows):
            these = [b for b in rows if b["kind"] == kind]
            arrays = np.frombuffer(b"".join(b["data"] for b in these), f"<{kind}").reshape(-1, tile, tile)
            yield kind, *(np.array([b[c] for b in these]) for c in ("tr", "tc")), [b["band"] for b in these], arrays


def to_blocks(cells: DataFrame, grid: Grid, value: str = "value", kind: str = "f8", band: str | None = None) -> DataFrame:
    """Blocks of a table of cells (row, col, value). band: a column that names the band; without one it is the value's name.

    Null values are missing, as are cells that aren't there; cells outside the grid, or without a row or column, are left out. Of repeated cells the greatest value holds.
    """
    ship_package(cells.sparkSession)
    tile = grid.tile
    name = F.col(band).cast("string") if band else F.lit(value)
    c = cells.select("row", "col", name.alias("band"), F.col(value).cast("double").alias("value"))
    c = c.filter(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
    c = grid.in_regions(c.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")}))

    def pack(t: pa.Table) -> pa.Table:
        row, col, tr, tc, v = (t.column(n).to_numpy() for n in ("row", "col", "tr", "tc", "value"))
        held, at = np.unique(tr.astype("i8") * (int(tc.max()) + 1) + tc, return_inverse=True)
        out = np.full((len(held), tile, tile), np.nan)
        order = np.argsort(np.where(np.isnan(v), -np.inf, v), kind="stable")  # of a cell's values the greatest is put last
        out[at[order], (row - tr * tile)[order], (col - tc * tile)[order]] = v[order]
        return _table(*np.divmod(held, int(tc.max()) + 1), [t.column("band")[0].as_py()] * len(held), kind, out)

    return c.groupBy("rr", "rc", "band").applyInArrow(pack, BLOCKS)


def to_cells(blocks: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """row, col, band, value of all positions of the blocks that lie in the grid; missing values are null."""
    ship_package(blocks.sparkSession)
    tile = grid.tile

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tr, tc, bands, a in _stacks(batches, tile):
            row, col = (np.broadcast_to(v, a.shape) for v in ((tr[:, None] * tile + np.arange(tile))[:, :, None], (tc[:, None] * tile + np.arange(tile))[:, None, :]))
            here = (row < grid.rows) & (col < grid.cols)
            v, which = a[here], np.nonzero(here)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[here].astype("i4")), pa.array(col[here].astype("i4")), pa.array(bands, pa.string()).take(pa.array(which)), pa.array(v.astype("f8"), mask=~known(v))], ["row", "col", "band", "value"],
            )

    return blocks.select("tr", "tc", "band", "kind", "data").mapInArrow(cells, "row int, col int, band string, value double").withColumnRenamed("value", value)


def border_strips(blocks: DataFrame, grid: Grid, pad: int, regions: Grid | None = None) -> DataFrame:
    """What each block gives to regions (without them, blocks), other than its own, within pad cells of it: the part of its array that the region's widened window covers.

    Strips without any value aren't sent. rr, rc: the region; top, left, height, width: where in its window of side + 2 pad.
    """
    regions = regions or grid
    tile, side, m, reach = grid.tile, regions.tile, regions.tile // grid.tile, -(-pad // regions.tile)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _slices(batches, tile):
            rows = []
            for b in blocks:
                rr, rc = b["tr"] // m, b["tc"] // m
                down, right = (b["tr"] - rr * m) * tile, (b["tc"] - rc * m) * tile  # of the block in its own region
                if min(down, right) >= pad and max(down, right) + tile + pad <= side:
                    continue
                a = _array(b["data"], b["kind"], (tile, tile))
                for i in range(-reach, reach + 1):
                    for j in range(-reach, reach + 1):
                        if (i or j) and regions.inside(rr + i, rc + j):
                            # the other's window begins at i * side - pad of this region
                            (r0, r1), (c0, c1) = ((max(o, d * side - pad), min(o + tile, (d + 1) * side + pad)) for d, o in ((i, down), (j, right)))
                            part = a[r0 - down : r1 - down, c0 - right : c1 - right] if r0 < r1 and c0 < c1 else a[:0]
                            if known(part).any():
                                rows.append((rr + i, rc + j, b["band"], b["kind"], r0 - i * side + pad, c0 - j * side + pad, r1 - r0, c1 - c0, np.ascontiguousarray(part).tobytes()))
            yield from _rows(rows, _STRIP).to_batches()

    return blocks.select("tr", "tc", "band", "kind", "data").mapInArrow(give, _STRIPS)


def focal(blocks: DataFrame, grid: Grid, pad: int, f: Callable[[np.ndarray, str], Iterator[tuple[str, np.ndarray]]], kind: str) -> DataFrame:
    """Blocks of what f makes of regions of blocks widened by pad cells on all sides: (band, array without the pad) pairs.

    f gets the array, missing where no neighbour has a value, and the band's name. Positions outside the grid are missing in the result, and blocks that aren't there
    have none. A region is one block, or as many small ones as make SPAN cells a side; a task holds one widened region and what f makes of it.
    """
    ship_package(blocks.sparkSession)
    tile, side = grid.tile, grid.regions().tile
    m = side // tile

    def run(own: pa.Table, strips: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        if not rows:
            return _rows([], _BLOCK)
        rr, rc, held = rows[0]["rr"], rows[0]["rc"], rows[0]["kind"] if len({b["kind"] for b in rows}) == 1 else "f8"
        wide = np.full((side + 2 * pad,) * 2, MISSING[held], f"<{held}")

        def put(b: dict, top: int, left: int, height: int, width: int) -> None:
            a = _array(b["data"], b["kind"], (height, width))
            wide[top : top + height, left : left + width] = a if b["kind"] == held else _array(_pack(a, held), held, (height, width))

        tr, tc = (np.array([b[c] for b in rows]) for c in ("tr", "tc"))
        for b in rows:
            put(b, (b["tr"] - rr * m) * tile + pad, (b["tc"] - rc * m) * tile + pad, tile, tile)
        for s in strips.to_pylist():
            put(s, s["top"], s["left"], s["height"], s["width"])
        out, past_row, past_col = [], max(0, grid.rows - rr * side), max(0, grid.cols - rc * side)
        for band, a in f(wide, rows[0]["band"]):
            if past_row < side or past_col < side:
                a = a.astype(f"<{kind}")
                a[past_row:], a[:, past_col:] = MISSING[kind], MISSING[kind]
            a = a.reshape(m, tile, m, tile).transpose(0, 2, 1, 3)[tr - rr * m, tc - rc * m]
            out.append(_table(tr, tc, [band] * len(rows), kind, a))
        return pa.concat_tables(out) if out else _rows([], _BLOCK)

    by = ("rr", "rc", "band")
    own = grid.in_regions(blocks.select("tr", "tc", "band", "kind", "data"))
    return own.groupBy(*by).cogroup(border_strips(blocks, grid, pad, grid.regions()).groupBy(*by)).applyInArrow(run, BLOCKS)


class Kernel:
    """Sums of all cells of a kernel around each cell of a block, from sums along rows, along columns, and over corners.

    The kernel (rows of kernel_rows, the widest in the middle) is a rectangle of its middle rows as wide as the narrowest of them, columns beside it, and rows above and
    below. Where the rectangle ends is chosen so that least is added up: a disk costs about 2.4 radius terms, a square four.
    """

    def __init__(self, radius: int, shape: str):
        half = {abs(d): h for d, h in kernel_rows(radius, shape)}
        self.radius, self.size = radius, sum(2 * half[abs(d)] + 1 for d in range(-radius, radius + 1))
        self.middle = min(range(radius + 1), key=lambda s: radius - s + half[0] - half[s])
        self.width = half[self.middle]
        self.rows = [(d, half[abs(d)]) for d in range(-radius, radius + 1) if abs(d) > self.middle]
        self.cols = [(c, max(d for d in range(self.middle + 1) if half[d] >= abs(c))) for c in range(-half[0], half[0] + 1) if abs(c) > self.width]

    def whole(self) -> np.dtype:
        """The least kind of whole number that holds a kernel's count; sums may wrap round on the way."""
        return np.dtype("u2" if self.size < 1 << 16 else "u4")

    def sums(self, grid: np.ndarray, tile: int) -> np.ndarray:
        r, kind, side = self.radius, grid.dtype, len(grid)
        along, down = np.zeros((side, side + 1), kind), np.zeros((side + 1, side), kind)
        np.cumsum(grid, axis=1, out=along[:, 1:], dtype=kind)
        np.cumsum(grid, axis=0, out=down[1:], dtype=kind)
        corner = np.zeros((side + 1, side + 1), kind)
        np.cumsum(along, axis=0, out=corner[1:], dtype=kind)

        def part(a: np.ndarray, row: int, col: int) -> np.ndarray:
            return a[r + row : r + row + tile, r + col : r + col + tile]

        s, w = self.middle, self.width
        out = part(corner, s + 1, w + 1) - part(corner, -s, w + 1)
        out -= part(corner, s + 1, -w)
        out += part(corner, -s, -w)
        for d, h in self.rows:
            out += part(along, d, h + 1)
            out -= part(along, d, -h)
        for c, v in self.cols:
            out += part(down, v + 1, c)
            out -= part(down, -v, c)
        return out


def class_name(k: int) -> str:
    return f"class_{k:02d}"


def focal_fractions(
    blocks: DataFrame, grid: Grid, classes: Sequence[int], radius: int, shape: str = "disk", denom: str = "valid", border: str = "truncate",
    empty: float | None = 0.0, kind: str = "f4",
) -> DataFrame:
    """A band class_01, ... for each class: its share among the cells around each cell. blocks: one band of whole-number classes.

    As raster.focal_class_fraction: denom 'valid' divides by the cells that have a class, 'kernel' by all cells of the kernel; without any valid cell
    the share is `empty`; border 'zero' leaves 0 within radius of the raster's edge.
    """
    kernel = Kernel(radius, shape)

    def shares(wide: np.ndarray, band: str) -> Iterator[tuple[str, np.ndarray]]:
        whole, has, side = kernel.whole(), known(wide), len(wide) - 2 * radius
        n = kernel.sums(has.astype(whole), side)
        none, every = n == 0, np.maximum(n, 1).astype(kind) if denom == "valid" else np.array(kernel.size, kind)
        present = np.unique(wide[has])
        for k in classes:
            out = kernel.sums((wide == k).astype(whole), side) / every if k in present else np.zeros((side, side), kind)
            out = out.astype(kind, copy=False)
            out[none] = np.nan if empty is None else empty
            yield class_name(k), out

    out = focal(blocks, grid, radius, shares, kind)
    return zero_border(out, grid, radius) if border == "zero" else out


def zero_border(blocks: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Blocks with 0 within a width of the raster's edge."""

    def clear(a: np.ndarray, tr: int, tc: int) -> np.ndarray:
        r, c = np.arange(grid.tile) + tr * grid.tile, np.arange(grid.tile) + tc * grid.tile
        edge = ((r < width) | (r >= grid.rows - width))[:, None] | (c < width) | (c >= grid.cols - width)
        return np.where(edge & (r < grid.rows)[:, None] & (c < grid.cols), 0, a)

    return _each(blocks, grid, clear)


def _each(blocks: DataFrame, grid: Grid, f: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """f of each block's array and number; no shuffle."""
    ship_package(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, tr, tc, bands, a in _stacks(batches, grid.tile):
            yield from _table(tr, tc, bands, kind, np.stack([f(*b) for b in zip(a, tr, tc, strict=True)])).to_batches()

    return blocks.select("tr", "tc", "band", "kind", "data").mapInArrow(run, BLOCKS)


def focal_mean(blocks: DataFrame, grid: Grid, radius: int, shape: str = "square") -> DataFrame:
    """The mean of the known values around each cell; missing where there is none."""
    kernel = Kernel(radius, shape)

    def mean(wide: np.ndarray, band: str) -> Iterator[tuple[str, np.ndarray]]:
        has, side = known(wide), len(wide) - 2 * radius
        n = kernel.sums(has.astype(kernel.whole()), side)
        total = kernel.sums(np.where(has, wide, 0).astype("f8"), side)
        yield band, np.where(n > 0, total / np.maximum(n, 1), np.nan)

    return focal(blocks, grid, radius, mean, "f8")


def lower_share(blocks: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """The share of the ring at a distance of radius cells that is higher than the centre; missing where the centre is."""
    r = radius
    ring = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if max(abs(a), abs(b)) == r]

    def share(wide: np.ndarray, band: str) -> Iterator[tuple[str, np.ndarray]]:
        v = np.where(known(wide), wide, np.nan).astype("f8")
        side = len(v) - 2 * r
        centre, n = v[r : r + side, r : r + side], np.zeros((side, side), np.int32)
        for a, b in ring:
            n += v[r + a : r + a + side, r + b : r + b + side] > centre
        yield band, np.where(np.isnan(centre), np.nan, n / (8.0 * r))

    return focal(blocks, grid, radius, share, "f8")


def coarsen(blocks: DataFrame, grid: Grid, factor: int, edge: str = "keep") -> tuple[DataFrame, Grid]:
    """Blocks of means of factor x factor cells, known ones alone, and their grid; no shuffle. The factor must divide the tile.

    edge 'truncate' leaves out the squares that the raster's edge cuts.
    """
    if grid.tile % factor:
        raise ValueError(f"a tile of {grid.tile} isn't a whole number of squares of {factor} cells")
    ship_package(blocks.sparkSession)
    n, up = grid.tile // factor, (lambda x: x // factor) if edge == "truncate" else (lambda x: -(-x // factor))
    small = Grid(n, up(grid.rows), up(grid.cols))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tr, tc, bands, a in _stacks(batches, grid.tile):
            has, squares = known(a), (len(a), n, factor, n, factor)
            count = has.reshape(squares).sum((2, 4))
            total = np.where(has, a, 0).astype("f8").reshape(squares).sum((2, 4))
            out = np.where(count > 0, total / np.maximum(count, 1), np.nan)
            past = ((tr[:, None] * n + np.arange(n)) >= small.rows)[:, :, None] | ((tc[:, None] * n + np.arange(n)) >= small.cols)[:, None, :]
            yield from _table(tr, tc, bands, "f8", np.where(past, np.nan, out)).to_batches()

    return blocks.select("tr", "tc", "band", "kind", "data").mapInArrow(mean, BLOCKS), small


def algebra(rasters: Mapping[str, DataFrame], grid: Grid, f: Callable[..., np.ndarray], band: str = "value", how: str = "inner") -> DataFrame:
    """A band made of several rasters of one grid, whole arrays at a time: f gets them by name, as doubles with NaN for missing values.

    Each raster has one band. how 'inner' takes the blocks that all have, 'full' any block: an absent one is all missing.
    """
    ship_package(next(iter(rasters.values())).sparkSession)
    names, joined = list(rasters), None
    for name in names:
        one = rasters[name].select("tr", "tc", F.struct("kind", "data").alias(name))
        joined = one if joined is None else joined.join(one.hint("merge"), ["tr", "tc"], how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _slices(batches, grid.tile):
            out = []
            for b in blocks:
                arrays = {}
                for name in names:
                    held = b[name]
                    a = _array(held["data"], held["kind"], (grid.tile, grid.tile)) if held else np.full((grid.tile, grid.tile), np.nan)
                    arrays[name] = np.where(known(a), a, np.nan).astype("f8")
                out.append((b["tr"], b["tc"], band, "f8", _pack(np.asarray(f(**arrays), "f8"), "f8")))
            yield from _rows(out, _BLOCK).to_batches()

    return joined.mapInArrow(run, BLOCKS)
