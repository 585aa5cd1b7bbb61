"""Spatial partitions that follow the data: a k-d tree of a bounded sample, leaves of about equally many rows, and searches over the leaves' boxes.

A city and the country around it get leaves of their own sizes, so that none is hot. The tree, with the box of the rows that each node really holds, is of
bounded size and goes to every task; rows meet by the number of their leaf. Rows are in one leaf each, however long they are: boxes may overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, small
from ..session import ship_package

#: Rows from which the tree is made (16 bytes each at the driver), and its depth, at most.
SAMPLE, DEEPEST = 1 << 20, 17


class Tree(NamedTuple):
    """Nodes in heap order: node n splits at value[n] of axis[n]; those from 2^depth - 1 on are leaves. box: xmin, ymin, xmax, ymax of a node's rows."""

    depth: int
    axis: np.ndarray
    value: np.ndarray
    box: np.ndarray
    held: np.ndarray

    @property
    def first(self) -> int:
        return (1 << self.depth) - 1


def split(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and values that halve a sample again and again, each time across its longer side; rows at the value go up."""
    n = (1 << depth) - 1
    axis, value, rows = np.zeros(n, np.int8), np.full(n, np.inf), {0: np.arange(len(sample))}
    for node in range(n):
        held = rows.pop(node)
        low = high = held
        if len(held):
            p = sample[held]
            a = int(np.ptp(p, axis=0).argmax())
            at = p[:, a]
            v = np.partition(at, len(at) // 2)[len(at) // 2]
            if at.min() == v and at.max() > v:  # many at the least value: they stay below
                v = at[at > v].min()
            axis[node], value[node] = a, v
            low, high = held[at < v], held[at >= v]
        rows[2 * node + 1], rows[2 * node + 2] = low, high
    return axis, value


def leaf_of(tree: Tree, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        node = 2 * node + 1 + (np.where(tree.axis[node] == 0, x, y) >= tree.value[node])
    return node - tree.first


def with_boxes(tree: Tree, leaves: Sequence[tuple]) -> Tree:
    """The tree with boxes and numbers of rows, given as (leaf, xmin, ymin, xmax, ymax, rows)."""
    n = 2 * tree.first + 1
    box, held = np.tile([np.inf, np.inf, -np.inf, -np.inf], (n, 1)), np.zeros(n, np.int64)
    for leaf, *b, rows in leaves:
        box[tree.first + leaf], held[tree.first + leaf] = b, rows
    for node in range(tree.first - 1, -1, -1):
        a, b = box[2 * node + 1], box[2 * node + 2]
        box[node], held[node] = [*np.minimum(a[:2], b[:2]), *np.maximum(a[2:], b[2:])], held[2 * node + 1] + held[2 * node + 2]
    return tree._replace(box=box, held=held)


def farthest(box: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.hypot(np.maximum(np.abs(x - box[:, 0]), np.abs(x - box[:, 2])), np.maximum(np.abs(y - box[:, 1]), np.abs(y - box[:, 3])))


def nearest_point(box: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    zero = np.zeros(len(x))
    return np.hypot(np.maximum.reduce([box[:, 0] - x, x - box[:, 2], zero]), np.maximum.reduce([box[:, 1] - y, y - box[:, 3], zero]))


def reach(tree: Tree, x: np.ndarray, y: np.ndarray, leaf: np.ndarray, need: int) -> np.ndarray:
    """A distance within which `need` rows lie for sure: that to the far end of the least node above that holds so many."""
    node, out = leaf + tree.first, np.full(len(x), np.inf)
    for _ in range(tree.depth + 1):
        new = np.isinf(out) & (tree.held[node] >= need)
        out[new] = farthest(tree.box[node[new]], x[new], y[new])
        node = (node - 1) // 2
    return out


def within(tree: Tree, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the point, leaf) for the leaves whose rows' box is no farther than d."""
    at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    d = d * (1 + 1e-9) + 1e-9  # whatever the rounding
    for level in range(tree.depth + 1):
        near = (tree.held[node] > 0) & (nearest_point(tree.box[node], x[at], y[at]) <= d[at])
        at, node = at[near], node[near]
        if level < tree.depth:
            at, node = np.repeat(at, 2), (2 * node[:, None] + [1, 2]).ravel()
    return at, node - tree.first


def _map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, schema)


def _added(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def plant(rows: DataFrame, x: Column, y: Column, box: Sequence[Column], leaf_rows: int = 64, sample: int = SAMPLE) -> tuple[DataFrame, Tree]:
    """rows with the number of their leaf, written, and the tree. x, y: where a row counts; box: xmin, ymin, xmax, ymax that it takes up.

    Leaves hold about leaf_rows rows each (more from 2^17 leaves on, and where rows can't be told apart by their place). The tree is made from
    all rows, or from about `sample` of them, picked by hash. Rows without a finite place mustn't be among them.
    """
    rows = cut(rows.withColumns({"_x": x, "_y": y, **{f"_b{i}": c for i, c in enumerate(box)}}))
    n = rows.count()
    some = rows.select("_x", "_y") if n <= sample else rows.filter(F.pmod(F.xxhash64("_x", "_y"), F.lit(1 << 30)) < int(sample / n * (1 << 30))).select("_x", "_y")
    places = some.toArrow()
    places = np.column_stack([places.column(c).to_numpy() for c in ("_x", "_y")]) if places.num_rows else np.zeros((0, 2))
    depth = max(0, min(DEEPEST, int(np.ceil(np.log2(max(n, 1) / leaf_rows))), int(np.log2(max(len(places), 1) / 4))))
    tree = Tree(depth, *split(places, depth), np.zeros(0), np.zeros(0))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("leaf", pa.array(leaf_of(tree, *_numbers(batch, "_x", "_y")), pa.int64()))

    rows = cut(_map(rows, place, _added(rows, ("leaf", T.LongType()))))
    ends = [F.min("_b0"), F.min("_b1"), F.max("_b2"), F.max("_b3")]
    leaves = rows.groupBy("leaf").agg(*ends, F.count(F.lit(1))).collect()  # 2^17 at most
    return rows.drop("_x", "_y", "_b0", "_b1", "_b2", "_b3"), with_boxes(tree, [tuple(r) for r in leaves])


def nearest(points: DataFrame, key: str, rows: DataFrame, tree: Tree, distance: Column, name: str, k: int = 1, keep: Column | None = None) -> DataFrame:
    """key, name, distance, rank: the k nearest rows of each point; equal distances go by name.

    points: key (once each), x, y (finite); rows and tree: of plant(); distance: of a point and a row; keep: pairs that count (one row a point may not).
    Each point meets the rows of its own leaf first. That, and the tree's boxes, give a distance within which the k nearest lie; then it meets the other leaves that
    come as near. So two joins by leaf, whatever the data look like; a leaf's points are a join's left side, which may be split.
    """
    need = k + (keep is not None)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    rows, order = small(rows), Window.partitionBy(key).orderBy("distance", name)

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("distance", distance)
        return pairs if keep is None else pairs.filter(keep)

    def best(pairs: DataFrame) -> DataFrame:
        if k == 1:
            got = pairs.groupBy(key).agg(F.min(F.struct("distance", name)).alias("m"))
            return got.select(key, F.col(f"m.{name}").alias(name), "m.distance", F.lit(1).alias("rank"))
        return pairs.select(key, name, "distance").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = _numbers(batch, "x", "y")
        leaf = leaf_of(shared.value, x, y)
        return batch.append_column("leaf", pa.array(leaf)).append_column("_d", pa.array(reach(shared.value, x, y, leaf, need)))

    p = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = cut(_map(p, own, _added(p, ("leaf", T.LongType()), ("_d", T.DoubleType()))))
    first = cut(best(measured(p.join(rows, "leaf"))))
    ends = first.filter(F.col("rank") == k).select(key, F.col("distance").alias("_end"))
    p = p.withColumnRenamed("leaf", "_own").join(ends.hint("merge"), key, "left").withColumn("_d", F.least("_d", "_end")).drop("_end")

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y, d, mine = _numbers(batch, "x", "y", "_d", "_own")
        at, leaf = within(shared.value, x, y, d)
        new = leaf != mine[at]
        return batch.take(pa.array(at[new])).append_column("leaf", pa.array(leaf[new]))

    more = measured(_map(p, others, _added(p, ("leaf", T.LongType()))).drop("_own").join(rows, "leaf"))
    more = more.filter(F.col("distance") <= F.col("_d") * (1 + 1e-9) + 1e-9)
    return best(first.select(key, name, "distance").unionByName(more.select(key, name, "distance")))
