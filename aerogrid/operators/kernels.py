"""Sums of kernels without an end, over all sources, without meeting them in pairs.

A gaussian is smooth on the scale of its own width. Sources of a square cell as wide as the gaussian become masses at ANCHORS x ANCHORS Chebyshev
points; masses act on the same points of the cells around, one axis after the other; points read the result by interpolation. An exponential kernel is a sum of
gaussians of growing width beyond a distance, and within that meets its sources in pairs that put right what the sum leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from ..session import ship_package

#: Points of a cell along an axis: gaussians of the cell's width are interpolated to 1e-15.
ANCHORS = 16
#: Cells, and widths, to which a gaussian reaches: 2e-22 of its height is left there.
REACH = 10
#: Cells along the side of a tile that is computed at once, and cells that a task holds before it hands them on.
TILE, HELD = 32, 2000
#: Pairs of cells that are taken one by one rather than a whole tile.
FEW_PAIRS = 8000
#: The step of the sum of gaussians (in the logarithm of 1 / width²): errors of 1e-14.
STEP = 0.3
#: What rounding and interpolation may add to a sum of weights of 1; a point whose sums this could change by TOLERANCE of them meets its sources in pairs.
NOISE, TOLERANCE = 1e-13, 1e-10

SUMS = ("ew", "w", "ew_noise", "w_noise")
CELLS = "level long, cx long, cy long, masses binary, ew_size double, w_size double"

_U = np.cos((np.arange(ANCHORS) + 0.5) * np.pi / ANCHORS)
_AT = (_U + 1) / 2  # within a cell
_BASIS = np.cos(np.outer(np.arange(ANCHORS), np.arccos(_U))) * (np.where(np.arange(ANCHORS) == 0, 1, 2) / ANCHORS)[:, None]


class Part(NamedTuple):
    """height * exp(-d² / (2 width²))"""

    height: float
    width: float


def gaussian_parts(bw: float) -> list[Part]:
    return [Part(1.0, float(bw))]


def exponential_parts(bw: float, near: float) -> list[Part]:
    """Gaussians that sum to exp(-d / bw) from `near` bandwidths on: exp(-r) is the integral of exp(-t r² - 1 / (4 t)) / (2 sqrt(pi t³)) over t, by a sum over log t."""
    t = np.exp(np.arange(np.log(0.004), np.log(32 / near**2), STEP))
    height = STEP * np.exp(-1 / (4 * t)) / (2 * np.sqrt(np.pi * t))
    return [Part(float(h), float(bw / np.sqrt(2 * u))) for h, u in zip(height, t, strict=True)]


def basis(u: np.ndarray) -> np.ndarray:
    """The ANCHORS interpolating polynomials at places 0 to 1 of a cell: a row a place."""
    return np.cos(np.arccos(np.clip(2 * u - 1, -1, 1))[:, None] * np.arange(ANCHORS)) @ _BASIS


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<f8").tobytes()


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """Of ((level, cx, cy), masses, (ew_size, w_size))."""
    cols = [pa.array([k[i] for k, _, _ in held], pa.int64()) for i in range(3)]
    sizes = [pa.array([float(size[i]) for _, _, size in held], pa.float64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([_blob(m) for _, m, _ in held], pa.binary()), *sizes], ["level", "cx", "cy", "masses", "ew_size", "w_size"])


def _masses(parts: list[Part]):
    """Sources to the masses of each cell of each level, and sums of |ew| and w, within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                x, y, ew, w = (whole.slice(start, 2000).column(i).to_numpy(zero_copy_only=False) for i in range(4))
                for level, part in enumerate(parts):
                    fx, fy = x / part.width, y / part.width
                    cx, cy = np.floor(fx), np.floor(fy)
                    order = np.lexsort((cy, cx))
                    kx, ky = cx[order], cy[order]
                    new = np.flatnonzero(np.r_[True, (np.diff(kx) != 0) | (np.diff(ky) != 0)])
                    outer = basis(fx[order] - kx)[:, None, :, None] * basis(fy[order] - ky)[:, None, None, :]
                    v = np.stack([ew[order], w[order]], 1)
                    sums, sizes = np.add.reduceat(outer * v[:, :, None, None], new), np.add.reduceat(np.abs(v), new)
                    for key, m, size in zip(zip(kx[new].astype(int).tolist(), ky[new].astype(int).tolist(), strict=True), sums, sizes, strict=True):
                        was = held.get((level, *key))
                        held[level, *key] = (m, size) if was is None else (was[0] + m, was[1] + size)
                    if len(held) >= HELD:
                        yield _rows([(k, *v) for k, v in held.items()])
                        held = {}
        yield _rows([(k, *v) for k, v in held.items()])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their cells: one a cell."""
    now, out = None, []
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for key, blob, *size in zip(keys, *(batch.column(i).to_pylist() for i in range(3, 6)), strict=True):
            m, size = np.frombuffer(blob, "<f8"), np.array(size)
            if now and now[0] == key:
                now = (key, now[1] + m, now[2] + size)
                continue
            if now:
                out.append(now)
            if len(out) >= HELD:
                yield _rows(out)
                out = []
            now = (key, m, size)
    yield _rows([*out, now] if now else out)


def spread(masses: np.ndarray) -> np.ndarray:
    """Of masses (cells in x, in y, 2, ANCHORS, ANCHORS) of a tile with REACH cells around: what they sum to at the tile's own points."""
    n = masses.shape[0] - 2 * REACH
    acts = [np.exp(-((_AT[:, None] - _AT[None, :] - d) ** 2) / 2) for d in range(-REACH, REACH + 1)]
    across = sum((a @ masses[i : i + n] for i, a in enumerate(acts) if masses[i : i + n].any()), np.zeros((n, *masses.shape[1:])))
    return sum((across[:, i : i + n] @ a.T for i, a in enumerate(acts) if across[:, i : i + n].any()), np.zeros((n, n, *masses.shape[2:])))


def _pairs(masses: np.ndarray, target: np.ndarray, source: np.ndarray, dx: np.ndarray, dy: np.ndarray, n: int) -> np.ndarray:
    """What masses of single cells sum to at the points of n cells: a pair of cells at a time, dx and dy cells apart."""
    out = np.zeros((n, 2, ANCHORS, ANCHORS))
    act = lambda d: np.exp(-((_AT[:, None] - _AT[None, :] - d[:, None, None]) ** 2) / 2)
    for i in range(0, len(target), 2000):
        t, s, a, b = (v[i : i + 2000] for v in (target, source, dx, dy))
        np.add.at(out, t, act(a)[:, None] @ masses[s] @ act(b)[:, None].transpose(0, 1, 3, 2))
    return out


def _fields(targets: pa.Table, cells: pa.Table) -> pa.Table:
    """A tile's cells that have points, and all cells with masses in reach of the tile, to (level, cx, cy, field, ew_noise, w_noise).

    Where pairs of cells are few they are taken one by one, else the whole tile at once.
    """
    (cx, cy), (sx, sy) = ([t.column(c).to_numpy() for c in ("cx", "cy")] for t in (targets, cells))
    blobs = cells.column("masses").to_pylist()
    masses = np.frombuffer(b"".join(blobs), "<f8").reshape(-1, 2, ANCHORS, ANCHORS)
    sizes = np.column_stack([cells.column(c).to_numpy() for c in ("ew_size", "w_size")])
    near = (np.abs(sx[None, :] - cx[:, None]) <= REACH) & (np.abs(sy[None, :] - cy[:, None]) <= REACH)
    t, s = np.nonzero(near)
    dx, dy = sx[s] - cx[t], sy[s] - cy[t]
    if len(t) <= FEW_PAIRS:
        field = _pairs(masses, t, s, dx, dy, len(cx))
    else:
        left, low = cx[0] // TILE * TILE, cy[0] // TILE * TILE
        whole = np.zeros((TILE + 2 * REACH, TILE + 2 * REACH, 2, ANCHORS, ANCHORS))
        whole[sx - left + REACH, sy - low + REACH] = masses
        field = spread(whole)[cx - left, cy - low]
    # interpolation errs by up to exp(-d² / 4) where the weight is exp(-d² / 2); d: at least so many widths between cells
    gap = np.exp(-(np.maximum(np.abs(dx) - 1, 0) ** 2 + np.maximum(np.abs(dy) - 1, 0) ** 2) / 4)
    noise = np.zeros((len(cx), 2))
    np.add.at(noise, t, sizes[s] * gap[:, None])
    return pa.table({
        **{c: targets.column(c) for c in ("level", "cx", "cy")}, "field": pa.array([_blob(f) for f in field], pa.binary()),
        **{c: pa.array(noise[:, k]) for k, c in enumerate(("ew_noise", "w_noise"))},
    })


def _read(parts: list[Part]):
    """Points with a cell's field to (key, ew, w, ew_noise, w_noise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                key, level, x, y, field, *noise = (batch.column(j) for j in range(7))
                part = [parts[k] for k in level.to_pylist()]
                width, height = (np.array([getattr(p, n) for p in part]) for n in ("width", "height"))
                fx, fy = x.to_numpy() / width, y.to_numpy() / width
                left, right = basis(fx - np.floor(fx)), basis(fy - np.floor(fy))
                f = np.frombuffer(b"".join(field.to_pylist()), "<f8").reshape(-1, 2, ANCHORS, ANCHORS)
                ew, w = np.einsum("na,ncab,nb->cn", left, f, right, optimize=True) * height
                yield pa.RecordBatch.from_arrays([key, pa.array(ew), pa.array(w), *(pa.array(v.to_numpy() * height) for v in noise)], ["_key", *SUMS])

    return run


def _cell(axis: str, parts: list[Part]) -> Column:
    """A point's cell at its level, by the same division as a source's."""
    return F.floor(F.col(axis) / F.element_at(F.array(*[F.lit(p.width) for p in parts]), (F.col("level") + 1).cast("int"))).cast("long")


def kernel_sums(points: DataFrame, key: str, sources: DataFrame, parts: list[Part]) -> DataFrame:
    """key, ew, w, ew_noise, w_noise: sums over all sources of (ew, w) times the parts, for each point, and how much of them is uncertain (times NOISE).

    points: key (once each), x, y; sources: x, y, ew, w (w not negative); all finite. Points that no source reaches have no row. Sources are
    summed to cells within tasks; cells, not sources, are exchanged between tiles, and a point meets one cell a part.
    """
    spark = points.sparkSession
    ship_package(spark)
    cells = sources.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "ew", "w")])
    least = min(p.width for p in parts)  # a task's sources by their cells: each cell is summed once, not once a batch
    cells = cells.sortWithinPartitions(F.floor(F.col("x") / least), F.floor(F.col("y") / least)).mapInArrow(_masses(parts), CELLS)
    cells = cut(cells.repartition("level", "cx", "cy").sortWithinPartitions("level", "cx", "cy").mapInArrow(_merged, CELLS))
    kind = points.schema[key].dataType
    at = points.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = at.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(parts) - 1).cast("long"))))
    at = at.withColumns({"cx": _cell("x", parts), "cy": _cell("y", parts)})
    by, tile = ("level", "tx", "ty"), lambda c: F.floor(F.col(c) / TILE)
    targets = at.select("level", "cx", "cy").distinct().withColumns({"tx": tile("cx"), "ty": tile("cy")})
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - REACH) / TILE), F.floor((F.col(c) + REACH) / TILE)))
    dealt = cells.withColumn("tx", near("cx")).withColumn("ty", near("cy")).join(targets.select(*by).distinct(), list(by), "left_semi")

    def fields_of(targets: pa.Table, cells: pa.Table) -> pa.Table:
        return _fields(targets, cells) if targets.num_rows and cells.num_rows else _fields(targets.slice(0, 0), cells.slice(0, 0))

    fields = cut(targets.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(fields_of, "level long, cx long, cy long, field binary, ew_noise double, w_noise double"))
    met = at.join(fields, ["level", "cx", "cy"]).select("_key", "level", "x", "y", "field", "ew_noise", "w_noise")
    schema = T.StructType([T.StructField("_key", kind), *(T.StructField(n, T.DoubleType()) for n in SUMS)])
    got = met.mapInArrow(_read(parts), schema).groupBy("_key").agg(*[F.sum(c).alias(c) for c in SUMS])
    return got.withColumnRenamed("_key", key)


def left_of_sum(d: Column, bw: float, parts: list[Part]) -> Column:
    """exp(-d / bw) less the gaussians that stand for it far away."""
    out = F.exp(-d / F.lit(float(bw)))
    for p in parts:
        out = out - F.lit(p.height) * F.exp(-d * d / F.lit(2 * p.width**2))
    return out
