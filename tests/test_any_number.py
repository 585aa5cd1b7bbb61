"""Kernels and searches where the other table is larger than what may be broadcast."""

import math
import random

import pytest

from aerogrid.operators import spatial as X


def _points(spark, n, seed, key="pid"):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, 5000), r.uniform(0, 5000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} int, x double, y double")


@pytest.mark.parametrize("name, weight", [("gaussian", lambda u: math.exp(-u * u / 2)), ("exponential", lambda u: math.exp(-u))])
def test_kernels_take_all_sources(spark, name, weight):
    rows, p = _points(spark, 20, 1)
    r = random.Random(2)
    sources = [(r.uniform(0, 5000), r.uniform(0, 5000), r.uniform(1, 9)) for _ in range(30)]
    got = {x["pid"]: x["emission"] for x in X.kernel_sources(p, spark.createDataFrame(sources, "x double, y double, emission double"), "pid", 400, name).collect()}
    for pid, x, y in rows:
        d = [math.hypot(x - sx, y - sy) for sx, sy, _ in sources]
        w = [weight(v / 400) for v in d]
        mean = sum(v * s[2] for v, s in zip(w, sources, strict=True)) / sum(w)
        assert got[pid] == (pytest.approx(mean) if min(d) <= 400 else None)


def test_far_points_meet_all_segments(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100_000.0, 0.0)], "pid int, x double, y double")
    r = spark.createDataFrame([(i, 10.0 + i, 5.0, 10.0 + i, -5.0) for i in range(9)], "link_id int, x1 double, y1 double, x2 double, y2 double")
    got = {x["pid"]: (x["link_id"], x["distance"]) for x in X.nearest_segment(p, r, "pid", "link_id", 2).collect()}
    assert got == {1: (0, 10.0), 2: (8, 99982.0)}


def test_neighbours_by_cells(spark):
    rows, _ = _points(spark, 120, 3)
    rows += [(200 + i, 2000.0, 2000.0) for i in range(8)] + [(300, 1e6, 1e6), (301, -3e5, 0.0)]
    out = X.nearest_neighbours(spark.createDataFrame([*rows, (400, None, 1.0)], "pid int, x double, y double"), "pid", 4)
    got = {}
    for r in out.collect():
        got.setdefault(r["pid"], {})[r["rank"]] = (r["distance"], r["neighbour"])
    for pid, x, y in rows:
        best = sorted((math.sqrt((x - nx) ** 2 + (y - ny) ** 2), o) for o, nx, ny in rows if o != pid)[:4]
        assert [got[pid][i + 1][1] for i in range(4)] == [o for _, o in best]
        assert [got[pid][i + 1][0] for i in range(4)] == pytest.approx([d for d, _ in best])
    assert len(got[400]) == 4
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
