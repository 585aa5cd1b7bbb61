"""Local regression and state-space smoothing, against plain versions over whole series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import loess as L
from aerogrid.operators import states as S


def line_at(ys, ws, q, x):
    """A local line at one place, value by value."""
    n = len(ys)
    nearest = sorted(range(n), key=lambda j: (abs(j - x), j))[: min(q, n)]
    if 0 <= x < n and q <= n:  # a centred window, moved inwards at the ends
        a = min(max(x - q // 2, 0), n - q)
        nearest = list(range(a, a + q))
    h = max(abs(j - x) for j in nearest) + max(0, (q - n) // 2)
    w = {}
    for j in nearest:
        d = abs(j - x)
        w[j] = (1.0 if d <= 0.001 * h else (1 - (d / h) ** 3) ** 3 if d <= 0.999 * h else 0.0) * ws[j]
    total = sum(w.values())
    if total <= 0:
        return ys[min(max(x, 0), n - 1)]
    mean = sum(v * j for j, v in w.items()) / total
    spread = sum(v * (j - mean) ** 2 for j, v in w.items()) / total
    value = sum(v * ys[j] for j, v in w.items()) / total
    if math.sqrt(spread) > 0.001 * (n - 1):
        value += (x - mean) * sum(v * (j - mean) * ys[j] for j, v in w.items()) / total / spread
    return value


def plain_stl(y, period, season, low, slow, rounds, robust):
    n, trend, w = len(y), [0.0] * len(y), [1.0] * len(y)
    mean = lambda v, k: [sum(v[i : i + k]) / k for i in range(len(v) - k + 1)]
    for again in range(robust + 1):
        for _ in range(rounds):
            cycle = [0.0] * (n + 2 * period)
            for p in range(period):
                own, ow = [y[i] - trend[i] for i in range(p, n, period)], w[p::period]
                for k in range(-1, len(own) + 1):
                    cycle[p + (k + 1) * period] = line_at(own, ow, season, k)
            passed = mean(mean(mean(cycle, period), period), 3)
            seasonal = [cycle[period + i] - line_at(passed, [1.0] * n, low, i) for i in range(n)]
            flat = [a - b for a, b in zip(y, seasonal, strict=True)]
            trend = [line_at(flat, w, slow, i) for i in range(n)]
        rest = [abs(a - b - c) for a, b, c in zip(y, seasonal, trend, strict=True)]
        six = 6 * float(np.median(rest))
        w = [1.0 if r <= 0.001 * six else (1 - (r / six) ** 2) ** 2 if r <= 0.999 * six else 0.0 for r in rest]
    return trend, seasonal


def series(seed, n, period):
    r = random.Random(seed)
    return [10 + 0.05 * i + 3 * math.sin(2 * math.pi * i / period) + r.gauss(0, 1) + (15 if r.random() < 0.03 else 0) for i in range(n)]


@pytest.mark.parametrize("robust, stretch", [(0, 40), (0, 20_000), (2, 55)])
def test_loess_decomposition_of_ten_series(spark, robust, stretch):
    # of two periods alone robust weights are a matter of rounding: a line through two values of which one weighs almost nothing
    period, given = 4, {f"s{k}": series(k, [150, 61, 90, 24 if robust else 8, 33][k % 5], 4) for k in range(9)} | {None: series(99, 120, 4)}
    rows = [(k, i, v, "clash") for k, ys in given.items() for i, v in enumerate(ys)] + [("short", i, 1.0, "clash") for i in range(7)]
    df = spark.createDataFrame(rows, "k string, t int, v double, trend0 string").repartition(3)
    out = L.decompose_loess(df, ["k"], "t", "v", period, season=7, slow=9, rounds=2, robust=robust, stretch=stretch)
    got = {(r["k"], r["t"]): r for r in out.collect()}
    assert len(got) == len(rows) and got["short", 0]["trend"] is None
    for k, ys in given.items():
        trend, seasonal = plain_stl(ys, period, 7, 5, 9, 2, robust)
        for i in range(len(ys)):
            r = got[k, i]
            assert (r["trend"], r["seasonal"]) == (pytest.approx(trend[i], abs=1e-8), pytest.approx(seasonal[i], abs=1e-8)), (k, i)
            assert r["trend"] + r["seasonal"] + r["remainder"] == pytest.approx(ys[i])


def test_loess_of_gaps_and_nothing(spark):
    df = spark.createDataFrame([("a", i, float(i) if i != 5 else None) for i in range(20)], "k string, t int, v double")
    with pytest.raises(Exception, match="unknown value at 5"):
        L.decompose_loess(df, ["k"], "t", "v", 4).collect()
    assert L.decompose_loess(df.limit(0), ["k"], "t", "v", 4).count() == 0
    with pytest.raises(ValueError):
        L.decompose_loess(df, ["k"], "t", "v", 1)


def dense(y, v):
    """The same least squares as one dense problem."""
    n, rows, right = len(y), [], []

    def add(cells, weight, value=0.0):
        e = np.zeros(2 * n)
        for at, x in cells:
            e[at] = x
        rows.append(e * math.sqrt(weight))
        right.append(value * math.sqrt(weight))

    add([(0, 1)], S.HELD[0])
    add([(1, 1)], S.HELD[1])
    for t in range(n):
        if y[t] is not None and abs(y[t]) < math.inf:
            add([(2 * t, 1)], 1 / v.noise, y[t])
        if t + 1 < n:
            add([(2 * t, -1), (2 * t + 1, -1), (2 * t + 2, 1)], 1 / v.level)
            add([(2 * t + 1, -1), (2 * t + 3, 1)], 1 / v.slope)
    return np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(n, 2)


@pytest.mark.parametrize("piece", [1, 7, 512])
def test_states_are_dense_least_squares(spark, piece):
    v, r = S.Variances(0.5, 0.2, 0.01), random.Random(piece)
    given = {f"s{k}": [None if r.random() < 0.3 else x for x in series(k, n, 7)] for k, n in enumerate([60, 1, 2, 14, 15, 43])} | {None: series(50, 29, 7), "none": [None] * 9, "one": [None, None, 4.0, None]}
    given["odd"] = [1.0, math.nan, 3.0, math.inf, None, 2.0]
    rows = [(k, i, y, "clash") for k, ys in given.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "k string, t int, y double, first string").repartition(3)
    got = {(x["k"], x["t"]): (x["level"], x["slope"]) for x in S.smooth_states(df, ["k"], "t", "y", v, piece).collect()}
    assert len(got) == len(rows) and got["none", 3] == (None, None)
    assert got["one", 0] == (pytest.approx(4, abs=1e-4), pytest.approx(0, abs=1e-4))
    for k, ys in given.items():
        if k not in ("none", "one", "s1"):
            want = dense(ys, v)
            for t in range(len(ys)):
                assert got[k, t] == pytest.approx(tuple(want[t]), abs=1e-5, rel=1e-6), (k, t)
    assert S.smooth_states(df.limit(0), ["k"], "t", "y", v).count() == 0


def test_one_long_series(spark):
    """100,000 rows of one series are many pieces; a steep line with gaps is found."""
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 < 3, F.col("id") * 0.5 + (F.col("id") % 2) * 0.1).alias("y"))
    out = S.impute_states(df, ["k"], "t", "y").agg(F.max(F.abs(F.col("y") - F.col("t") * 0.5)), F.count("y")).first()
    assert out[0] < 0.2 and out[1] == 100_000


def test_imputing_with_a_season(spark):
    rows = [("a", t, None if t % 11 == 3 else 5.0 + (t % 7)) for t in range(140)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    got = {r["t"]: r["y"] for r in S.impute_states(df, ["k"], "t", "y", period=7).collect()}
    assert all(got[t] == pytest.approx(5.0 + t % 7, abs=0.2) for t in range(140))
