"""What fits have in common is done once."""

import pytest
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aerogrid.operators import models as M
from aerogrid.operators import splines as S


@pytest.fixture(scope="module")
def rows(spark):
    day = F.when(F.col("id") < 900, "2021-01-01").otherwise("2022-01-01").cast("date")
    return spark.range(1200).selectExpr("id", "cast(id % 61 as double) a", "cast(id % 7 as double) b", "cast(id * 31 % 97 as double) y", "cast(id % 4 as int) fold").withColumn("date", day)


def test_learners_read_rows_dealt_once(spark, rows, monkeypatch):
    deals, plans = [], []
    dealt, fit = M.dealt, LinearRegression._fit
    monkeypatch.setattr(M, "dealt", lambda df: deals.append(1) or dealt(df))
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or fit(self, df))
    got = M.benchmark_models(rows, ["y"], {"two": ["a", "b"], "one": ["a"]}, "date", "2022-01-01", ["elastic", "linear"])
    assert len(deals) == 3 and len(plans) == 4 and all("InMemoryTableScan" in p for p in plans)
    assert [(r["features"], r["learner"], r["n"]) for r in got.collect()] == [(f, x, 300) for f in ("two", "one") for x in ("elastic", "linear")]
    for r in got.filter("learner = 'linear'").collect():
        terms = ["a", "b"] if r["features"] == "two" else ["a"]
        x = VectorAssembler(inputCols=terms, outputCol="features").transform(rows)
        model = LinearRegression(labelCol="y").fit(x.filter("id < 900"))
        assert M.metrics(model.transform(x.filter("id >= 900")), "y", "prediction").first()["rmse"] == pytest.approx(r["rmse"], abs=1e-9)


class Counted(Estimator):
    """Steps that say when they are fitted."""

    fits: list = []

    def _fit(self, df):
        self.fits.append(df.count())
        return VectorAssembler(inputCols=["a", "b"], outputCol="features")


def test_steps_are_fitted_once_a_fold(spark, rows):
    design = [{"regParam": 0.0}, {"regParam": 1.0}, {"regParam": 1e5}]
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    ran = M.tune(rows, [Counted()], LinearRegression(labelCol="y"), design, "y", 4, race_after=None).collect()
    assert Counted.fits == [900] * 4 and spark.sparkContext._jsc.getPersistentRDDs().size() <= kept
    assert sorted((r["config"], r["fold"]) for r in ran) == [(i, f) for i in range(3) for f in range(4)]
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    for r in ran:
        model = LinearRegression(labelCol="y", **design[r["config"]]).fit(x.filter(F.col("fold") != r["fold"]))
        assert M.metrics(model.transform(x.filter(F.col("fold") == r["fold"])), "y", "prediction").first()["rmse"] == pytest.approx(r["rmse"], abs=1e-9)


def test_a_vector_is_unpacked_once_a_row(rows):
    """Also when predictions are scored: a filter on them would be moved below the model with all that it says."""
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = S.PenalisedSplines(labelCol="y").fit(x)
    plan = M.metrics(model.transform(x), "y", "prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 2  # the assembler's and the unpacking


def test_metrics_pass_over_the_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 9.0), ("a", 4.0, None), ("a", 3.0, 5.0), ("b", None, 1.0)], "k string, y double, p double")
    assert [(r["k"], r["rmse"], r["mae"], r["rsq"], r["n"]) for r in M.metrics(df, "y", "p", ["k"]).collect()] == [("a", pytest.approx(2.5**0.5), 1.5, pytest.approx(1.0), 2)]
    assert M.metrics(df.filter("k = 'b'"), "y", "p").first()["n"] == 0
