"""Queries on folds, metrics, models and writers. Model fits have no SQL."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import series as W
from ..scratch import cut, new_path
from ..sources import sinks as K
from ..streaming.daily import read_stream, summarize_daily_stream
from .tables import Tables

Q: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


TERMS = ["p_size", "brand_no", "key_mod", "name_len"]


def _samples(t: Tables):
    """Rows of part as a regression table."""
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 37).cast("double").alias("key_mod"),
        F.coalesce(F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("double"), F.lit(0.0)).alias("brand_no"), F.length("p_name").cast("double").alias("name_len"),
        F.col("p_type").alias("kind"), (F.lit(2018) + F.col("p_partkey") % 6).cast("int").alias("year"), (F.col("p_partkey") * 7919 % 20000).cast("double").alias("x"),
        (F.col("p_partkey") * 6101 % 20000).cast("double").alias("y2"), F.make_date(F.lit(2018) + F.col("p_partkey") % 6, F.lit(7), F.lit(1)).alias("date"),
    )


def _assembled(t: Tables):
    rows = _samples(t)
    model = Pipeline(stages=[VectorAssembler(inputCols=TERMS, outputCol="features"), M.boosted_trees("y", maxIter=5, maxDepth=3)]).fit(M.dealt(rows))
    return rows, model


@query("SELECT pid, mtpi, mtpi_1km, dem, 'pm10 ~ dem + mtpi + mtpi_1km' AS formula FROM (SELECT p.pid, t.* FROM {points} p LEFT JOIN {terrain} t ON t.row = floor((1920000 - p.y) / 500) AND t.col = floor((p.x - 900000) / 400))")
def select_terms(t: Tables):
    """The columns of the feature table that a model's patterns choose."""
    from ..operators import raster as R

    features = R.sample_at_points(t.points, t.terrain, R.Frame(900_000.0, 1_920_000.0, 400.0, 500.0), ("dem", "dsm", "mtpi", "mtpi_1km"))
    terms = M.select_terms(features, ["^mtpi", "^d.m$"], drop=["dsm"])
    return features.select("pid", *terms, F.lit(M.formula("pm10", terms)).alias("formula"))


@query(
    """WITH s AS (SELECT tmsid2, date, pm10, CASE WHEN row_number() OVER (PARTITION BY tmsid2 ORDER BY date) <= floor(count(*) OVER (PARTITION BY tmsid2) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {daily}),
    m AS (SELECT avg(pm10) AS m, stddev_samp(pm10) AS s FROM s WHERE split = 'train') SELECT tmsid2, date, round((pm10 - m) / s, 4) AS pm10 FROM s, m"""
)
def normalise_by_train(t: Tables):
    df = W.station_split(t.daily, ["tmsid2"], "date")
    return M.normalise_by_train(df, ["pm10"]).select("tmsid2", "date", F.round("pm10", 4).alias("pm10"))


@query("SELECT pid, dense_rank() OVER (ORDER BY pid % 7) - 1 AS fold FROM {points}")
def grouped_folds(t: Tables):
    return M.grouped_folds(t.points.withColumn("g", F.col("pid") % 7), "g").select("pid", F.col("fold").cast("bigint").alias("fold"))


@query(
    """WITH b AS (SELECT bx, b_y, (row_number() OVER (ORDER BY b_y, CASE WHEN b_y % 2 = 0 THEN bx ELSE -bx END) - 1) % 5 AS fold FROM (SELECT DISTINCT floor(x / 5000)::BIGINT AS bx, floor(y / 5000)::BIGINT AS b_y FROM {points}))
    SELECT pid, fold FROM {points} JOIN b ON bx = floor(x / 5000) AND b_y = floor(y / 5000)"""
)
def block_folds(t: Tables):
    return M.block_folds(t.points, 5000.0).select("pid", F.col("fold").cast("bigint").alias("fold"))


@query("SELECT pid, (('0x' || substr(md5('0:' || pid), 1, 12))::BIGINT % 5)::INT AS fold FROM {points}")
def random_folds(t: Tables):
    return M.folds(t.points, None, "pid").select("pid", "fold")


@query("SELECT tmsid, round(sqrt(avg((pm10 - 2 * pm25) * (pm10 - 2 * pm25))), 3) AS rmse, round(avg(abs(pm10 - 2 * pm25)), 3) AS mae, round(pow(corr(pm10, 2 * pm25), 2), 5) AS rsq, count(*) AS n FROM {daily} WHERE pm10 IS NOT NULL AND pm25 IS NOT NULL GROUP BY tmsid")
def metrics_by_station(t: Tables):
    df = M.metrics(t.daily.withColumn("p", F.col("pm25") * 2), "pm10", "p", ["tmsid"])
    return df.select("tmsid", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("rsq", 5).alias("rsq"), "n")


@query("SELECT round((sum(pow(pm10 - 5000, 2)) / count(pm10) + sum(pow(pm25 - 2500, 2)) / count(pm25)) / 2, 0) AS loss FROM {measurements}")
def masked_loss(t: Tables):
    df = t.measurements.withColumns({"a": F.lit(5000.0), "b": F.lit(2500.0)})
    return M.masked_loss(df, [("pm10", "a"), ("pm25", "b")]).select(F.round("loss", 0).alias("loss"))


@query("SELECT pid AS gid, x - y AS diff FROM {points}")
def prediction_difference(t: Tables):
    a, b = (t.points.select(F.col("pid").alias("gid"), F.col(c).alias("value")) for c in ("x", "y"))
    return M.prediction_difference(a, b).select("gid", "diff")


@query("SELECT tmsid2, date, pm10 AS y_true, pm25 AS y_pred, pm10 - pm25 AS residual FROM {daily}")
def residuals(t: Tables):
    return M.with_residual(t.daily, "pm10", "pm25").select("tmsid2", "date", "y_true", "y_pred", "residual")


SAMPLES_SQL = """s AS (SELECT p_partkey AS id, p_retailprice AS y, p_size::DOUBLE AS p_size, (p_partkey % 37)::DOUBLE AS key_mod, coalesce(try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE), 0.0) AS brand_no,
  length(p_name)::DOUBLE AS name_len, p_type AS kind, (2018 + p_partkey % 6)::INT AS year, (p_partkey * 7919 % 20000)::DOUBLE AS x, (p_partkey * 6101 % 20000)::DOUBLE AS y2 FROM part)"""
_SCALED = ", ".join(f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) END AS {c}" for c in TERMS)


@query(f"WITH {SAMPLES_SQL} SELECT id, {_SCALED} FROM s")
def standard_preprocessing(t: Tables):
    """The scaled features by name; a constant one is dropped, and null here."""
    from pyspark.ml.functions import vector_to_array

    df = _samples(t)
    model = Pipeline(stages=M.standard_steps(TERMS)).fit(df)
    kept = [TERMS[i] for i in model.stages[1].selectedFeatures]
    out = model.transform(df).withColumn("f", vector_to_array("features"))
    at = {c: F.round(F.get("f", F.lit(i)), 6) for i, c in enumerate(kept)}
    return out.select("id", *[at.get(c, F.lit(None).cast("double")).alias(c) for c in TERMS])


@query(
    f"""WITH {SAMPLES_SQL}, m AS (SELECT *, CASE WHEN id % 11 <> 0 THEN p_size END AS size0 FROM s),
    k AS (SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind) - 1 AS level FROM m GROUP BY kind)
    SELECT id, coalesce(size0, (SELECT quantile_disc(size0, 0.5) FROM m)) AS p_size, level::DOUBLE AS level, (SELECT 1 + count(*) + 2 FROM k)::INT AS n_features FROM m JOIN k USING (kind)"""
)
def mixed_preprocessing(t: Tables):
    """The filled number, the level of the kind (by the place of its dummy), and how many features there are."""
    from pyspark.ml.functions import vector_to_array

    df = _samples(t).withColumn("p_size", F.when(F.col("id") % 11 != 0, F.col("p_size")))
    out = Pipeline(stages=M.mixed_steps(["p_size"], ["kind"], ["key_mod", "brand_no", "name_len"], 2)).fit(df).transform(df)
    out = out.withColumns({"f": vector_to_array("features"), "d": vector_to_array("kind_dummy")})
    return out.select("id", F.get("f", F.lit(0)).alias("p_size"), (F.array_position("d", F.lit(1.0)) - 1).cast("double").alias("level"), F.size("f").alias("n_features"))


@query()
def impute_forest(t: Tables):
    cols = ["chars", "rest", "words"]
    return M.impute_forest(t.document_features, cols, "id", trees=20, rounds=2, donors=3).select("id", *[F.round(c, 6).alias(c) for c in cols])


@query()
def tune_by_racing(t: Tables):
    df = M.random_folds(_samples(t), "id", 4)
    design = M.latin_hypercube({"maxDepth": (2, 4), "minInstancesPerNode": (2, 30), "stepSize": (-2, -0.5)}, 10, whole=["maxDepth", "minInstancesPerNode"], powers=["stepSize"])
    steps = [VectorAssembler(inputCols=TERMS, outputCol="features")]
    return M.tune(df, steps, M.boosted_trees("y", maxIter=3), design, "y", 4, race_after=2)


@query()
def benchmark_models(t: Tables):
    return M.benchmark_models(_samples(t), ["y"], {"all": TERMS, "two": TERMS[:2]}, "date", "2022-01-01", ["boosted", "elastic", "forest", "additive"])


_LINE = "avg({y}) - regr_slope({y}, {x}) * avg({x}) AS a, regr_slope({y}, {x}) AS b"


@query(
    f"""WITH {SAMPLES_SQL}, m AS (SELECT {_LINE.format(y='y', x='key_mod')} FROM s WHERE year < 2022),
    e AS (SELECT y, a + b * key_mod AS p FROM s, m WHERE year >= 2022)
    SELECT 'y' AS target, 'one' AS features, 'linear' AS learner, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(pow(corr(y, p), 2), 6) AS rsq, count(*) AS n FROM e"""
)
def benchmark_linear(t: Tables):
    out = M.benchmark_models(_samples(t), ["y"], {"one": ["key_mod"]}, "date", "2022-01-01", ["linear"])
    return out.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "rsq": F.round("rsq", 6)})


@query()
def fit_predict_year(t: Tables):
    grid = t.points.select(F.col("pid").alias("gid"), "x", "y", *[(F.col("pid") % (5 + i)).cast("double").alias(c) for i, c in enumerate(TERMS)])
    train = _samples(t).withColumnRenamed("y", "price")
    return M.fit_predict_year(train, grid, 2020, "price", TERMS, M.boosted_trees("price", maxIter=5, maxDepth=3))


def _on_grid(t: Tables):
    return t.points.select(F.col("pid").alias("gid"), "x", "y", (F.col("pid") % 37).cast("double").alias("key_mod"))


@query(f"WITH {SAMPLES_SQL}, m AS (SELECT {_LINE.format(y='y', x='key_mod')} FROM s WHERE year = 2020) SELECT pid AS gid, x, y, 2020 AS year, round(a + b * (pid % 37), 3) AS value FROM {{points}}, m")
def fit_predict_linear(t: Tables):
    train = _samples(t).withColumnRenamed("y", "price")
    return M.fit_predict_year(train, _on_grid(t), 2020, "price", ["key_mod"], M.LEARNERS["linear"]("price")).withColumn("value", F.round("value", 3))


@query(
    f"""WITH {SAMPLES_SQL}, m AS (SELECT {_LINE.format(y='y', x='key_mod')} FROM s WHERE year = 2020), o AS (SELECT {_LINE.format(y='y', x='(key_mod * 0.5 + id % 5)')} FROM s WHERE year = 2020)
    SELECT pid AS gid, round((m.a + m.b * (pid % 37)) - (o.a + o.b * (pid % 37)), 3) AS diff FROM {{points}}, m, o"""
)
def relocation_linear(t: Tables):
    a = _samples(t).withColumnRenamed("y", "price")
    b = a.withColumn("key_mod", F.col("key_mod") * 0.5 + F.col("id") % 5)
    out = M.relocation_impact(a, b, _on_grid(t), 2020, "price", ["key_mod"], lambda: M.LEARNERS["linear"]("price"))
    return out.select("gid", F.round("diff", 3).alias("diff"))


@query()
def relocation_impact(t: Tables):
    grid = t.points.select(F.col("pid").alias("gid"), "x", "y", *[(F.col("pid") % (5 + i)).cast("double").alias(c) for i, c in enumerate(TERMS)])
    a = _samples(t).withColumnRenamed("y", "price")
    b = a.withColumn("key_mod", F.col("key_mod") * 0.5)
    return M.relocation_impact(a, b, grid, 2020, "price", TERMS, lambda: M.boosted_trees("price", maxIter=3, maxDepth=3))


@query()
def top_importance(t: Tables):
    _, model = _assembled(t)
    return M.top_importance(model, TERMS, t.spark)


@query()
def permutation_importance(t: Tables):
    rows, model = _assembled(t)
    return M.permutation_importance(model, rows, TERMS, "y", "id")


@query(
    f"""WITH {SAMPLES_SQL}, m AS (SELECT {_LINE.format(y='y', x='key_mod')} FROM s), i AS (SELECT *, row_number() OVER (ORDER BY id) AS i, row_number() OVER (ORDER BY ('0x' || substr(md5('1:' || id), 1, 12))::BIGINT, id) AS j FROM s),
    e AS (SELECT p.y, a + b * p.key_mod AS own, a + b * q.key_mod AS other FROM i p JOIN i q ON p.i = q.j, m)
    SELECT 'key_mod' AS variable, round(sqrt(avg((y - own) * (y - own))), 4) AS base_rmse, round(sqrt(avg((y - other) * (y - other))), 4) AS rmse FROM e"""
)
def permutation_linear(t: Tables):
    """Up to 100,000 rows are one part, whose values change places by a drawn order."""
    rows = _samples(t)
    model = Pipeline(stages=[VectorAssembler(inputCols=["key_mod"], outputCol="features"), M.LEARNERS["linear"]("y")]).fit(rows)
    out = M.permutation_importance(model, rows, ["key_mod"], "y", "id")
    return out.select("variable", F.round("base_rmse", 4).alias("base_rmse"), F.round("rmse", 4).alias("rmse"))


@query()
def shapley_importance(t: Tables):
    rows, model = _assembled(t)
    return M.shapley_importance(model, rows, TERMS, "id", 2)


@query()
def moving_window_tuning(t: Tables):
    design = M.latin_hypercube({"maxDepth": (2, 4), "stepSize": (-1.5, -0.5)}, 2, whole=["maxDepth"], powers=["stepSize"])
    rows = _samples(t).drop("y2").withColumn("price", F.col("y")).withColumn("y", (F.col("id") * 6101 % 20000).cast("double"))
    return M.moving_window_tuning(rows, ["price"], TERMS[:2], [2021, 2023], design, learner=lambda label: M.boosted_trees(label, maxIter=3), components=TERMS[2:], k=2, least_rows=50)


@query(
    f"""WITH {SAMPLES_SQL}, y AS (SELECT 2021 AS ty UNION ALL SELECT 2023), w AS (SELECT ty, s.* FROM y JOIN s ON s.year BETWEEN ty - 3 AND ty),
    m AS (SELECT ty, {_LINE.format(y='y', x='key_mod')} FROM w WHERE year < ty GROUP BY ty), e AS (SELECT w.ty, y, a + b * key_mod AS p FROM w JOIN m ON m.ty = w.ty WHERE year = w.ty)
    SELECT 'price' AS target, ty AS test_year, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(pow(corr(y, p), 2), 6) AS rsq, count(*) AS n FROM e GROUP BY ty"""
)
def moving_window_linear(t: Tables):
    """One configuration of a linear model, which needs no race."""
    rows = _samples(t).withColumn("price", F.col("y"))
    out = M.moving_window_tuning(rows, ["price"], ["key_mod"], [2021, 2023], [{}], learner="linear", least_rows=10)
    return out.select("target", "test_year", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("rsq", 6).alias("rsq"), "n")


# --- writers, by what they write ----------------------------------------------------------------------------------
def _folder(t: Tables) -> str:
    return new_path(t.spark)


@query("SELECT date, count(*) AS n FROM {daily} GROUP BY date")
def write_partitioned(t: Tables):
    path = _folder(t)
    K.write_table(t.daily, path, ["date"])
    return t.spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tmsid, pm10 FROM (SELECT tmsid, MAX(pm10) AS pm10 FROM {daily} GROUP BY tmsid)")
def write_csv(t: Tables):
    path = _folder(t)
    K.write_csv(t.daily.groupBy("tmsid").agg(F.max("pm10").alias("pm10")), path)
    return t.spark.read.csv(path, header=True, schema="tmsid string, pm10 double")


@query("SELECT event_id, pm10 FROM {measurements} WHERE pm10 > 5000")
def copy_query(t: Tables):
    path = _folder(t)
    K.copy_query(t.spark, "SELECT event_id, pm10 FROM {m} WHERE pm10 > 5000", path, m=t.measurements)
    return t.spark.read.parquet(path)


@query("SELECT 'pm10' AS outcome, (2020 + pid % 2)::INT AS year, x, y, x + y AS value FROM {points}")
def write_surfaces(t: Tables):
    path = _folder(t)
    K.write_surfaces(t.points.select(F.lit("pm10").alias("outcome"), (F.lit(2020) + F.col("pid") % 2).alias("year"), "x", "y", (F.col("x") + F.col("y")).alias("value")), path)
    return t.spark.read.parquet(path).select("outcome", F.col("year").cast("int").alias("year"), "x", "y", "value")


@query("SELECT row, col, class, value FROM {landuse} WHERE class IS NOT NULL")
def write_by_class(t: Tables):
    path = _folder(t)
    K.write_by_class(t.landuse.filter("class IS NOT NULL"), path)
    return t.spark.read.parquet(path).select("row", "col", F.col("class").cast("int").alias("class"), "value")


@query("SELECT pid, x, y FROM {points}")
def save_table(t: Tables):
    """Written twice: replaced by the second, and left alone by a third that doesn't replace. The table is dropped once it is read."""
    name = f"aerogrid_{uuid.uuid4().hex}"
    K.save_table(t.points.limit(1), name)
    K.save_table(t.points, name)
    K.save_table(t.points.limit(1), name, replace=False)
    out = cut(t.spark.table(name))
    t.spark.sql(f"DROP TABLE {name}")
    return out


@query("SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice, p_name LIMIT 1")
def write_best(t: Tables):
    path = _folder(t)
    K.write_best(t.part.orderBy("p_retailprice", "p_name").limit(1).select("p_name", "p_retailprice"), path)
    return t.spark.read.schema("p_name string, p_retailprice double").json(path)


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type, AVG(ROUND(value * 100)) AS v, (CASE WHEN COUNT(*) < 18 THEN 1 ELSE 0 END)::INT AS v_flag FROM events GROUP BY 1, 2)
    SELECT * FROM d WHERE date + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 2 DAYS FROM events)"""
)
def daily_stream(t: Tables):
    """The daily summary of events as a stream that appends each day once, when its readings can no longer be late; run until no file is left.

    Days that end within two days of the last reading are still open, and have no row yet.
    """
    events, path = t.events, _folder(t)
    stream = read_stream(t.spark, t.sf_dir, events.schema, only="events.parquet")
    rows = stream.select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).alias("v"))
    daily = summarize_daily_stream(rows, "ts", ["event_type"], ["v"])
    writer = daily.writeStream.outputMode("append").format("parquet").option("path", path)
    writer.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_type string, v double, v_flag int, date date").parquet(path).select("date", "event_type", "v", "v_flag")
