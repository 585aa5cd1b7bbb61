"""Penalised splines against dense least squares in NumPy."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from aerogrid.operators import models as M
from aerogrid.operators import splines as S


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.uniform(-3, 3, 600), rng.uniform(0, 1, 600), np.full(600, 7.0)])
    return x, np.sin(x[:, 0]) * 3 + x[:, 1] + 2 + rng.normal(0, 0.2, 600)


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(*map(float, r), float(v)) for r, v in zip(*data, strict=True)] + [(0.0, 0.0, 7.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def dense(x, y, curves, strengths):
    """Rows of data and of penalties in one least-squares problem."""
    a, k = S.design(x, curves), 1
    extra = []
    for c, s in zip([c for c in curves if c.width], strengths, strict=True):
        block = np.zeros((c.width - 2, a.shape[1]))
        block[:, k : k + c.width] = np.sqrt(s) * np.diff(np.eye(c.width), 2, axis=0)
        extra.append(block)
        k += c.width
    beta = np.linalg.lstsq(np.vstack([a, *extra]), np.r_[y, np.zeros(sum(map(len, extra)))], rcond=None)[0]
    return a @ beta


@pytest.mark.parametrize("strengths", [(1e-3, 1e-3), (10.0, 0.1), (1e5, 1e5)])
def test_fits_are_those_of_dense_least_squares(spark, data, table, strengths):
    x, y = data
    curves = [S.Curve(x[:, i].min(), x[:, i].max(), 10) for i in range(3)]
    total = S.products(table.selectExpr("array(a, b, c) AS x", "y").filter("y IS NOT NULL"), curves)
    a = np.column_stack([S.design(x, curves), y])
    assert total == pytest.approx(a.T @ a, rel=1e-9, abs=1e-9)
    got = S.penalised(total, curves, strengths)
    want = dense(x, y, curves, strengths)
    assert S.design(x, curves) @ got.coefficients == pytest.approx(want, abs=1e-5)
    hat = np.column_stack([dense(x, e, curves, strengths) for e in np.eye(len(y))])
    assert got.score == pytest.approx(len(y) * ((y - want) ** 2).sum() / (len(y) - np.trace(hat)) ** 2, rel=1e-4)


def test_the_model_finds_the_curve(data, table):
    x, y = data
    model = S.PenalisedSplines(labelCol="y").fit(table)
    got = {r["a"]: r["prediction"] for r in model.transform(table).collect()}
    curves, fit = model.curves, model.fit_
    for v, p in zip(x, S.design(x, curves) @ fit.coefficients, strict=True):
        assert got[v[0]] == pytest.approx(p, abs=1e-9)
    assert np.sqrt(np.mean([(got[v[0]] - np.sin(v[0]) * 3 - v[1] - 2) ** 2 for v in x])) < 0.08
    assert fit.strengths[1] > fit.strengths[0] and curves[2].width == 0  # the straight feature is held straighter


def test_beyond_the_range_and_nothing_to_fit(spark, table):
    model = S.PenalisedSplines(labelCol="y").fit(table)
    far = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame([(99.0, 0.5, 7.0), (model.curves[0].high, 0.5, 7.0)], "a double, b double, c double"))
    a, b = (r["prediction"] for r in model.transform(far).collect())
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        S.PenalisedSplines(labelCol="y").fit(table.limit(0))


def test_splines_are_a_learner(table):
    assert isinstance(M.LEARNERS["additive"]("y"), S.PenalisedSplines)
