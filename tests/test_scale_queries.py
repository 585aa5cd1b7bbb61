"""Queries against their SQL on tables larger, or with more copies, than the given ones."""

import duckdb
from pyspark.sql import functions as F

from aerogrid import catalog


def same_as_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    text = lambda rows: sorted(tuple(repr(v) for v in r) for r in rows)
    mine = text(tuple(r[c] for c in cols) for r in df.collect())
    return mine == text(con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()) and mine


def test_tiles_are_those_of_the_sql(spark, small, tmp_path):
    part = spark.read.parquet(f"{small}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 60_000)).write.parquet(f"{tmp_path}/part.parquet")
    assert same_as_sql(spark, "tiles_with_halo", tmp_path, ["part"])


def test_medians_are_exact(spark):
    from pyspark.ml import Pipeline

    from aerogrid.operators import models as M

    df = spark.range(40_001).select("id", F.when(F.col("id") > 0, (F.col("id") * 7919 % 40_009).cast("double")).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("b"))
    values = {c: sorted(r[0] for r in df.select(c).dropna().collect()) for c in ("a", "b")}
    got = Pipeline(stages=M.mixed_steps(["a", "b"], [])).fit(df).transform(df)
    for c, v in values.items():
        assert [r[0] for r in got.filter(F.col(c).isNull()).select(f"{c}_filled").distinct().collect()] == [v[(len(v) - 1) // 2]]


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_features_and_rasters_are_never_broadcast(spark):
    """Spark would broadcast them, by the size of their files."""
    from aerogrid.operators import joins, raster

    base = spark.range(100).selectExpr("id", "cast(id as double) x", "cast(-id as double) y", "1995 year")
    a, b = base.selectExpr("id", "x as a"), base.selectExpr("id", "1994 as year", "y as b")
    assert joins_of(joins.merge_features(base, [a, a.withColumnRenamed("a", "c")], ["id"])) == (2, 0)
    assert joins_of(joins.lagged_join(base, b, "year")) == (1, 0)
    cells = spark.range(200).selectExpr("cast(id as int) row", "cast(id as int) col", "1.0D value")
    assert joins_of(raster.sample_at_points(base, cells, raster.Frame(0.0, 0.0, 1.0, 1.0))) == (1, 0)


def test_pieces_of_circles_are_compiled(spark):
    """Methods of more than 8000 bytes are interpreted by the JVM; shares are those of circle_cover to the bit."""
    from aerogrid.functions.geometry import circle_cover, with_circle_cover
    from aerogrid.operators import raster

    points = spark.range(30).selectExpr("id", "cast(id * 37 % 100 as double) x", "cast(id * 61 % 100 as double) y")
    pieces = raster.circle_pieces(points, "id", [40, 90], raster.Frame(0.0, 100.0, 10.0, 9.0))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(pieces._jdf.queryExecution().executedPlan())
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000
    box = [F.col("x"), F.col("y"), F.lit(70.0), F.col("i") * 10.0, F.col("id") * 3.0, F.col("i") * 10.0 + 10, F.col("id") * 3.0 + 9]
    both = with_circle_cover(points.withColumn("i", F.explode(F.sequence(F.lit(-2), F.lit(12)))), *box).withColumn("other", circle_cover(*box))
    assert both.filter(F.col("cover") > 0).count() > 100 and both.filter(F.col("cover") != F.col("other")).isEmpty()


def test_estates_of_one_shape_are_one(spark, small, tmp_path, monkeypatch):
    from aerogrid.plans import shape_queries as Q

    supplier = spark.read.parquet(f"{small}/supplier.parquet")
    supplier.unionByName(supplier.withColumn("s_suppkey", F.col("s_suppkey") + 20_000)).write.parquet(f"{tmp_path}/supplier.parquet")
    clips = []
    monkeypatch.setattr(Q.X, "kernel_sources", lambda points, *a, clip, **k: clips.append(clip) or points.withColumn("emission", F.lit(0.0)))
    spark.read.parquet(f"{small}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    catalog.queries()["multi_ring_kernel"](spark, str(tmp_path))
    assert clips[0].select("feature").distinct().count() == supplier.count()
