"""Partitions that follow the data: bounded leaves under skew, and searches over them against all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import leaves as L
from aerogrid.operators import spatial as X


def town(r, n):
    """Half of all rows in a square of one metre, the others over 100 km."""
    return [(r.uniform(5000, 5001), r.uniform(7000, 7001)) if i % 2 else (r.uniform(0, 1e5), r.uniform(0, 1e5)) for i in range(n)]


def planted(spark, places, leaf_rows=16, **how):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "id int, rx double, ry double")
    x, y = F.col("rx"), F.col("ry")
    return L.plant(df, x, y, [x, y, x, y], leaf_rows, **how)


@pytest.mark.parametrize("sample", [1 << 20, 600])
def test_leaves_are_bounded_in_a_town(spark, sample):
    rows, tree = planted(spark, town(random.Random(1), 4000), 16, sample=sample)
    held = [r["count"] for r in rows.groupBy("leaf").count().collect()]
    assert sum(held) == 4000 and max(held) <= (32 if sample > 4000 else 160) and tree.held[0] == 4000


def test_rows_at_one_place(spark):
    rows, tree = planted(spark, [(1.0, 1.0)] * 300 + [(2.0, 1.0)] * 3 + [(1.0, 0.0)], 16)
    assert rows.count() == 304 and tree.held[tree.first :].max() == 300
    empty, tree = planted(spark, [], 16)
    assert empty.count() == 0 and tree.held[0] == 0


def test_boxes_bound_and_find():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (500, 2))
    tree = L.Tree(5, *L.split(p, 5), np.zeros(0), np.zeros(0))
    leaf = L.leaf_of(tree, p[:, 0], p[:, 1])
    size = rng.exponential(3, 500)  # rows reach beyond their leaf
    tree = L.with_boxes(tree, [(k, *(p[leaf == k] - size[leaf == k, None]).min(0), *(p[leaf == k] + size[leaf == k, None]).max(0), (leaf == k).sum()) for k in set(leaf.tolist())])
    q = rng.uniform(-50, 150, (200, 2))
    away = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1])
    for need in (1, 7, 500):
        bound = L.reach(tree, q[:, 0], q[:, 1], L.leaf_of(tree, q[:, 0], q[:, 1]), need)
        assert (np.sort(away)[:, need - 1] <= bound).all()
    assert np.isinf(L.reach(tree, q[:1, 0], q[:1, 1], np.zeros(1, int), 501)).all()
    d = rng.uniform(0, 40, 200)
    at, found = L.within(tree, q[:, 0], q[:, 1], d)
    pairs = set(zip(at.tolist(), found.tolist(), strict=True))
    assert len(pairs) == len(at) and {(i, int(leaf[j])) for i in range(200) for j in np.flatnonzero(away[i] <= d[i])} <= pairs


@pytest.mark.parametrize("leaf_rows", [2, 64])
def test_nearest_segments_in_a_town(spark, leaf_rows):
    r = random.Random(4)
    roads = [(i, x, y, x + r.uniform(-1, 1) * w, y + r.uniform(-1, 1) * w) for i, (x, y) in enumerate(town(r, 600)) for w in [r.choice([0.3, 0.0, 4000])]]
    roads += [(1000, *roads[5][1:]), (-7, *roads[8][1:]), (2000, 0.0, 0.0, 1e5, 1e5)]
    points = [(i, *p) for i, p in enumerate(town(r, 300))] + [(900, 5e6, 5e6), (901, 5000.5, 7000.5), (901, 5000.5, 7000.5), (902, None, 1.0)]
    out = X.nearest_segment(spark.createDataFrame(points, "pid int, x double, y double"), spark.createDataFrame(roads, "link int, x1 double, y1 double, x2 double, y2 double"), "pid", "link", leaf_rows)
    got = {x["pid"]: (x["distance"], x["link"]) for x in out.collect()}
    a = np.array([s[1:] for s in roads])
    for pid, x, y in points[:-1]:
        dx, dy = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]
        s = dx * dx + dy * dy
        t = np.clip(np.divide((x - a[:, 0]) * dx + (y - a[:, 1]) * dy, s, out=np.zeros(len(s)), where=s > 0), 0, 1)
        d = np.hypot(x - a[:, 0] - t * dx, y - a[:, 1] - t * dy)
        assert got[pid][0] == pytest.approx(d.min(), rel=1e-9, abs=1e-9)
        assert got[pid][1] in {roads[j][0] for j in np.flatnonzero(d <= d.min() + 1e-9)}
    assert got[901] and len(got) == 302 and -7 in {v[1] for v in got.values()} | {-7}


@pytest.mark.parametrize("leaf_rows", [4, 64])
def test_neighbours_in_a_town(spark, leaf_rows):
    r = random.Random(6)
    rows = [(i, *p) for i, p in enumerate(town(r, 300))] + [(300 + i, 5000.25, 7000.25) for i in range(20)] + [(400, None, 2.0), (401, math.inf, 2.0)]
    out = X.nearest_neighbours(spark.createDataFrame(rows, "pid int, x double, y double"), "pid", 3, leaf_rows)
    got = {}
    for x in out.collect():
        got.setdefault(x["pid"], {})[x["rank"]] = x["neighbour"]
    placed = [p for p in rows if p[0] < 400]
    for pid, x, y in placed:
        want = sorted((math.hypot(ox - x, oy - y), o) for o, ox, oy in placed if o != pid)[:3]
        assert [got[pid][i] for i in (1, 2, 3)] == [o for _, o in want], pid
    assert [list(got[i].values()) for i in (400, 401)] == [[0, 1, 2]] * 2


def test_too_few_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, None, None), (4, None, 0.0)], "pid int, x double, y double")
    got = sorted((r["pid"], r["rank"], r["neighbour"], r["distance"]) for r in X.nearest_neighbours(df, "pid", 3).collect())
    assert got[:3] == [(1, 1, 2, 5.0), (1, 2, 3, None), (1, 3, 4, None)] and [g[2] for g in got if g[0] == 3] == [1, 2, 4]
    assert X.nearest_neighbours(df.filter("pid = 1"), "pid", 3).count() == X.nearest_neighbours(df.limit(0), "pid", 3).count() == 0
