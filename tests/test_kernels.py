"""Endless kernels by cells against all pairs."""

import math
import random

import numpy as np
import pytest

from aerogrid.operators import kernels as K
from aerogrid.operators import spatial as X

WEIGHTS = {"gaussian": lambda u: np.exp(-u * u / 2), "exponential": lambda u: np.exp(-u)}


def all_pairs(points, sources, bw, name):
    s = np.array([(x, y, math.nan if e is None else e, w) for x, y, e, w in sources if x is not None and abs(x) < math.inf])
    out = {}
    for key, x, y in points:
        d = np.hypot(x - s[:, 0], y - s[:, 1])
        w = np.where(np.isnan(s[:, 2]), 0, WEIGHTS[name](d / bw) * s[:, 3])
        out[key] = (np.nan_to_num(s[:, 2]) * w).sum() / w.sum() if d.min() <= bw and w.sum() > 0 else None
    return out


@pytest.mark.parametrize("name, bw, by_cells", [("gaussian", 400.0, True), ("gaussian", 20_000.0, True), ("exponential", 1000.0, True), ("exponential", 30.0, False), ("gaussian", 30.0, False)])
def test_all_sources_count(spark, monkeypatch, name, bw, by_cells):
    if by_cells:
        monkeypatch.setattr(X, "FREE_PAIRS", 0)
        monkeypatch.setattr(X, "PAIRS", 40)
    r = random.Random(int(bw))
    sources = [(r.uniform(-9000, 9000), r.uniform(-9000, 9000), r.uniform(0, 9), r.choice([0.0, 1.0, 2.5])) for _ in range(400)]
    sources += [(5.0, 5.0, 1e6, 1e3)] * 50 + [(100.0, 100.0, None, 1.0), (None, 3.0, 1.0, 1.0), (math.inf, 3.0, 1.0, 1.0)]
    points = [(i, r.uniform(-9000, 9000), r.uniform(-9000, 9000)) for i in range(120)] + [(200, 5.0, 5.0), (201, 5.0 + 7 * bw, 5.0), (202, 1e7, 1e7), (203, 100.0, 100.0 + bw)]
    p = spark.createDataFrame([*points, (300, None, 0.0)], "pid int, x double, y double")
    s = spark.createDataFrame(sources, "x double, y double, emission double, share double")
    got = {x["pid"]: x["emission"] for x in X.kernel_sources(p, s, "pid", bw, name, weight="share").collect()}
    want = all_pairs(points, sources, bw, name)
    assert got.pop(300) is None
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
    for k, v in want.items():
        assert v is None or got[k] == pytest.approx(v, rel=1e-9), k


@pytest.mark.parametrize("name", WEIGHTS)
def test_one_source_beside_a_far_town(spark, monkeypatch, name):
    """The near source weighs little beside what the town could add by rounding: such points meet their sources in pairs."""
    monkeypatch.setattr(X, "FREE_PAIRS", 0)
    town = [(6000.0 + i % 100, 6000.0 + i // 100, 1e9, 1e6) for i in range(5000)]
    lone = [(0.0, 0.0, 1.0, 1e-9)]
    p = spark.createDataFrame([(1, 3.0, 4.0)], "pid int, x double, y double")
    s = spark.createDataFrame(town + lone, "x double, y double, emission double, share double")
    got = X.kernel_sources(p, s, "pid", 1000.0, name, weight="share").first()["emission"]
    assert got == pytest.approx(all_pairs([(1, 3.0, 4.0)], town + lone, 1000.0, name)[1], rel=1e-9)


def test_no_source_and_no_weight(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double")
    s = spark.createDataFrame([(1.0, 1.0, 3.0, 0.0)], "x double, y double, emission double, share double")
    for name in WEIGHTS:
        assert X.kernel_sources(p, s.limit(0), "pid", 10.0, name).first()["emission"] is None
        assert X.kernel_sources(p, s, "pid", 10.0, name, weight="share", empty=-1.0).first()["emission"] == -1.0
        assert X.kernel_sources(p.limit(0), s, "pid", 10.0, name).count() == 0


def test_gaussians_stand_for_the_exponential():
    for near in (0.125, 0.5, 4, 32):
        r = np.concatenate([np.linspace(near, 5 + near, 500), np.linspace(5 + near, 80, 500)])
        total = sum(p.height * np.exp(-(r**2) / (2 * p.width**2)) for p in K.exponential_parts(1.0, near))
        assert np.abs(total - np.exp(-r)).max() < 1e-13


def test_pairs_of_cells_are_the_whole_tile():
    rng = np.random.default_rng(7)
    side = K.TILE + 2 * K.REACH
    masses = np.zeros((side, side, 2, K.ANCHORS, K.ANCHORS))
    at = rng.integers(0, side, (15, 2))
    masses[at[:, 0], at[:, 1]] = rng.uniform(0, 1, (15, 2, K.ANCHORS, K.ANCHORS))
    at = np.unique(at, axis=0)
    cells = rng.integers(0, K.TILE, (9, 2))
    d = at[None] - K.REACH - cells[:, None]
    t, s = np.nonzero((np.abs(d) <= K.REACH).all(2))
    got = K._pairs(masses[at[:, 0], at[:, 1]], t, s, d[t, s, 0], d[t, s, 1], 9)
    assert np.allclose(got, K.spread(masses)[cells[:, 0], cells[:, 1]], rtol=1e-12)


def test_fields_of_a_tile():
    rng = np.random.default_rng(2)
    side = 3 + 2 * K.REACH
    masses = np.zeros((side, side, 2, K.ANCHORS, K.ANCHORS))
    places, held = rng.uniform(0, side, (60, 2)), rng.uniform(0, 5, (60, 2))
    for (x, y), v in zip(places, held, strict=True):
        one = np.outer(K.basis(np.array([x % 1]))[0], K.basis(np.array([y % 1]))[0])
        masses[int(x), int(y)] += v[:, None, None] * one
    field = K.spread(masses)
    for x, y in rng.uniform(0, 3, (20, 2)):
        got = np.einsum("a,cab,b->c", K.basis(np.array([x % 1]))[0], field[int(x), int(y)], K.basis(np.array([y % 1]))[0])
        d2 = ((places - K.REACH - [x, y]) ** 2).sum(1)
        assert got == pytest.approx((held * np.exp(-d2 / 2)[:, None]).sum(0), rel=1e-11)
