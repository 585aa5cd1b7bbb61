"""Models and their parts against what can be worked out by hand."""

import itertools

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerogrid.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 10, 240), rng.uniform(0, 10, 240)
    data = [(i, float(x), float(z), float(4 * x - z), 2015 + i % 5, float(i % 12), float(i // 12)) for i, (x, z) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, y double, year int, x double, y2 double")


@pytest.fixture(scope="module")
def line(rows):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(labelCol="y")]).fit(rows)


def test_losers_leave_the_race():
    assert M.still_racing({0: [1.0, 1.1, 0.9], 1: [1.0, 1.2, 0.8], 2: [3.0, 3.1, 2.9]}) == [0, 1]
    assert M.still_racing({0: [1.0, 1.0], 1: [2.0, 2.0]}) == [0]
    assert M.still_racing({0: [1.0, 5.0, 1.0], 1: [2.0, 1.0, 9.0]}) == [0, 1]


def test_a_hopeless_configuration_runs_fewer_folds(rows):
    df = M.random_folds(rows, "id", 5)
    steps = [VectorAssembler(inputCols=["a", "b"], outputCol="features")]
    design = [{"regParam": 0.0}, {"regParam": 1e6}]
    ran = M.tune(df, steps, LinearRegression(labelCol="y"), design, "y", 5, race_after=2)
    folds = {r["config"]: r["n"] for r in ran.groupBy("config").agg(F.count("fold").alias("n")).collect()}
    assert folds == {0: 5, 1: 2}
    assert M.best_config(ran, 5) == {"regParam": 0.0}


def test_tree_importance_finds_the_one_feature(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("double").alias("u"), (F.col("id") % 7).cast("double").alias("w"), (F.col("id") % 7 * 10).cast("double").alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["u", "w"], outputCol="features"), M.boosted_trees("y", maxIter=3, maxDepth=3)]).fit(df)
    got = M.top_importance(model, ["u", "w"], spark).collect()
    assert [(r["variable"], r["rank"]) for r in got] == [("w", 1), ("u", 2)] and got[0]["importance"] > 0.95


def test_shapley_of_a_linear_model(rows, line):
    """A linear model's share of a feature is its slope times the distance from the rows that are met, whatever the order."""
    got = {r["variable"]: r["importance"] for r in M.shapley_importance(line, rows, ["a", "b"], "id", samples=60).collect()}
    data = rows.toPandas()
    for t, slope in (("a", 4.0), ("b", -1.0)):
        assert got[t] == pytest.approx((slope * (data[t] - data[t].mean())).abs().mean(), rel=0.1)


def test_shuffling_keeps_values_and_other_columns(rows):
    was, orders = rows.toPandas(), []
    for parts in (1, 3, 40):
        out = M.shuffled_column(rows, "a", "id", parts=parts).toPandas().sort_values("id")
        orders.append(out["a"].tolist())
        assert sorted(out["a"]) == sorted(was["a"]) and (out["b"].to_numpy() == was["b"].to_numpy()).all()
        assert (out["a"].to_numpy() != was["a"].to_numpy()).mean() > 0.8
    assert orders[0] == orders[1] == orders[2]  # one order of the whole table, however it is dealt


def test_permutation_hurts_the_steeper_feature_more(rows, line):
    got = {r["variable"]: r["increase"] for r in M.permutation_importance(line, rows, ["a", "b"], "y", "id").collect()}
    assert got["a"] > got["b"] > 0


def test_blocks_are_dealt_along_a_snake(spark):
    cells = list(itertools.product(range(-2, 3), range(4)))
    df = spark.createDataFrame([(i, bx * 10 + 1.0, by * 10 + 1.0) for i, (bx, by) in enumerate(cells)], "id int, x double, y double")
    got = {r["id"]: r["fold"] for r in M.block_folds(df, 10.0, 3).collect()}
    along = sorted(cells, key=lambda c: (c[1], c[0] if c[1] % 2 == 0 else -c[0]))
    assert got == {i: along.index(c) % 3 for i, c in enumerate(cells)}


def test_windows_tune_and_score_each_year(rows):
    df = rows.withColumnRenamed("y", "target").withColumnRenamed("y2", "y")
    got = M.moving_window_tuning(df, ["target"], ["a", "b"], [2018, 2019, 2012], [{"regParam": 1e5}, {"regParam": 0.0}], learner="linear", k=3, block=4.0, least_rows=20)
    out = {r["test_year"]: r for r in got.collect()}
    assert set(out) == {2018, 2019}  # 2012 has no years before it
    assert all(r["params"] == '{"regParam": 0.0}' and r["rmse"] < 1e-6 and r["n"] == 48 and r["importance"] is None for r in out.values())


def test_windows_without_rows(rows):
    df = rows.withColumnRenamed("y", "target").withColumnRenamed("y2", "y")
    assert M.moving_window_tuning(df, ["target"], ["a"], [1990], [{}], learner="linear").count() == 0


def test_rows_to_fit_on_are_dealt_out(spark, monkeypatch):
    """One task's rows become many tasks' of bounded size, always the same; few are left alone."""
    monkeypatch.setattr(M, "FIT_ROWS", 500)
    df = spark.range(4000).selectExpr("cast(id % 61 as double) a", "cast(id % 7 as double) b", "cast(id * 31 % 97 as double) y", "id").coalesce(1)
    parts = [df.rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect() for df in (M.dealt(df), M.dealt(df.orderBy("y")))]
    assert parts[0] == parts[1] and len(parts[0]) == 8 and max(map(len, parts[0])) < 700 and sum(map(len, parts[0])) == 4000
    assert M.dealt(df.limit(500)).rdd.getNumPartitions() == 1
    seen = []
    fit = M.GBTRegressor._fit
    monkeypatch.setattr(M.GBTRegressor, "_fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    M.benchmark_models(df.withColumn("date", F.when(F.col("id") < 3000, "2021-01-01").otherwise("2022-01-01").cast("date")), ["y"], {"all": ["a", "b"]}, "date", "2022-01-01", ["boosted"])
    M.fold_scores(df.withColumn("fold", (F.col("id") % 2).cast("int")), [VectorAssembler(inputCols=["a", "b"], outputCol="features")], M.boosted_trees("y", maxIter=1), {}, "y", 0)
    assert seen == [6, 4]
