"""What grows faster than the input must not be broadcast, nor met once for each copy of a place."""

from pyspark.sql import functions as F

from aerogrid.operators import raster as R


def broadcast_explosions(df) -> bool:
    """Whether the plan broadcasts rows that it explodes first: their number isn't in any estimate of size."""
    depth = None
    for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if "BroadcastExchange" in line and depth is None:
            depth = at
        if depth is not None and ("Generate" in line or "explode(" in line):
            return True
    return False


def scattered(spark, path, n, places=None):
    """n points on a square of 20 km, read from a small file."""
    i = F.col("id") % (places or n)
    spark.range(n).select(F.col("id").alias("pid"), (i * 7919 % 20000).cast("double").alias("x"), (i * 6101 % 20000).cast("double").alias("y")).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_pieces_of_circles_are_not_broadcast(spark, tmp_path):
    pts = scattered(spark, tmp_path / "p", 300, 200)
    cells = spark.range(60 * 50).select((F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), (F.col("id") % 7).cast("double").alias("value"))
    frame = R.Frame(0.0, 20000.0, 400.0, 500.0)
    out = R.zonal_sums(pts, "pid", [1500, 3000], cells, frame)
    assert not broadcast_explosions(out)
    got = {(r["pid"], r["radius"]): (r["total"], r["weight"]) for r in out.collect()}
    covers = R.buffer_cells(pts, "pid", [1500, 3000], frame).join(cells, ["row", "col"])
    want = covers.groupBy("pid", "radius").agg(F.sum(F.col("value") * F.col("cover")).alias("t"), F.sum("cover").alias("w")).collect()
    assert len(got) == len(want) == 600
    assert all(abs(got[r["pid"], r["radius"]][0] - r["t"]) < 1e-6 and abs(got[r["pid"], r["radius"]][1] - r["w"]) < 1e-6 for r in want)


def test_days_of_circles_against_each_cell(spark):
    pts = spark.range(40).select("id", (F.col("id") * 7919 % 20000).cast("double").alias("x"), (F.col("id") * 6101 % 20000).cast("double").alias("y"))
    pts = pts.unionByName(spark.createDataFrame([(40, None, 5.0)], pts.schema))
    i = F.col("id")
    cells = spark.range(20 * 20 * 5).select(
        (i / 5 % 20).cast("int").alias("row"), (i / 100).cast("int").alias("col"), F.date_add(F.lit("1969-12-20").cast("date"), (i % 5 * 90).cast("int")).alias("date"),
        F.when(i % 3 != 0, (i % 11).cast("double")).alias("a"), F.when(i < 900, (i % 13).cast("double")).alias("b"),
    )
    frame = R.Frame(0.0, 20000.0, 1000.0, 1000.0)
    for coverage in ("exact", "centre"):
        got = {(r["id"], r["date"]): r for r in R.zonal_days(pts, "id", [900, 2500], cells, frame, ["a", "b"], coverage).collect()}
        covers = R.buffer_cells(pts.dropna(), "id", [900, 2500], frame, coverage).join(cells, ["row", "col"])
        mean = lambda v, r: F.sum(F.when(F.col("radius") == r, F.col(v) * F.col("cover"))) / F.sum(F.when((F.col("radius") == r) & F.col(v).isNotNull(), F.col("cover")))
        names = [(v, r) for v in ("a", "b") for r in (900, 2500)]
        want = covers.filter("a IS NOT NULL OR b IS NOT NULL").groupBy("id", "date").agg(*[mean(v, r).alias(f"{v}_{r}") for v, r in names]).collect()
        assert len(got) == len(want) > 150
        for r in want:
            for c in (f"{v}_{k}" for v, k in names):
                mine = got[r["id"], r["date"]][c]
                assert (mine is None) == (r[c] is None) and (mine is None or abs(mine - r[c]) < 1e-9)


def test_kernels_meet_places_not_copies(spark, tmp_path):
    from aerogrid.operators import spatial as X

    pts = scattered(spark, tmp_path / "p", 400, 40)
    sources = scattered(spark, tmp_path / "s", 3000, 300).withColumn("emission", (F.col("pid") % 17).cast("double")).withColumn("share", (F.col("pid") % 4).cast("double"))
    out = X.kernel_sources(pts, sources, "pid", 1500, "tricube", weight="share")
    assert not broadcast_explosions(out)
    assert X.merged_sources(sources.selectExpr("x AS sx", "y AS sy", "emission AS e", "share AS xw")).count() == 300
    s = sources.selectExpr("x AS sx", "y AS sy", "emission AS e", "share AS xw")
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    w = X.kernel("tricube", d, 1500) * F.col("xw")
    want = pts.crossJoin(s).groupBy("pid").agg((F.sum(F.col("e") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("m"))
    got, want = (sorted((r[0], r[1]) for r in df.collect()) for df in (out, want))
    assert len(got) == 400
    assert all(a[0] == b[0] and (a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) < 1e-9) for a, b in zip(got, want, strict=True))


def test_weather_of_wanted_days_only(spark):
    i = F.col("id")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + i % 20 * 86_400)
    cells = spark.range(400 * 20).select((i / 20 % 20).cast("int").alias("row"), (i / 400).cast("int").alias("col"), F.lit("tp").alias("variable"), ts.alias("ts"), (i % 11).cast("double").alias("value"))
    pts = spark.range(5).select("id", (i * 3000.0 + 500).alias("x"), (i * 2000.0 + 500).alias("y"))
    weather = lambda **how: R.daily_weather(pts, "id", cells, R.Frame(0.0, 20000.0, 1000.0, 1000.0), [1500], {"tp": "sum"}, **how)
    days = spark.sql("SELECT DATE '2024-01-03' AS date UNION ALL SELECT DATE '2024-01-03' UNION ALL SELECT DATE '2030-01-01'")
    assert sorted(map(tuple, weather(days=days).collect())) == sorted(map(tuple, weather().filter("date = DATE '2024-01-03'").collect()))
