import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerogrid.operators import aggregates as A
from aerogrid.operators import joins as J
from aerogrid.operators import models as M
from aerogrid.operators import series as W
from aerogrid.operators import sites as H
from aerogrid.operators import spatial as X
from aerogrid.sources import readers as S
from aerogrid.sources import sinks as K


@pytest.fixture(scope="module")
def line(spark):
    rows = [("a", dt.date(2024, 1, d), None if d % 4 == 0 else float(d)) for d in range(1, 21) if d % 5]
    return spark.createDataFrame(rows, "id string, date date, v double")


def test_interpolation_passes_through_known_values(line):
    full = W.complete_series(line, ["id"], "date")
    got = {r["date"].day: r["v"] for r in W.interpolate_linear(full, ["id"], "date", ["v"]).collect()}
    assert got == {d: pytest.approx(float(d)) for d in range(1, 20)}


def test_fill_and_winsorise(line):
    filled = W.fill_down_up(line, ["id"], ["date"], ["v"])
    assert filled.filter("v IS NULL").count() == 0
    capped = W.winsorise(line, "v", 0.0, ["id"])
    fence = line.select(W.upper_fence("v", 0.0)).first()[0]
    assert capped.agg(F.max("v")).first()[0] <= fence


def test_extend_grid_has_every_day(spark):
    rows = [(1, dt.date(2024, 2, 27), dt.date(2024, 3, 2)), (1, dt.date(2024, 2, 27), dt.date(2024, 3, 2)), (2, None, dt.date(2024, 1, 1)), (3, dt.date(2024, 1, 2), dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "k int, date_start date, date_end date")
    assert H.extend_grid(df, ["k"]).groupBy("k").count().collect() == [(1, 5)]


def test_backward_years(spark):
    df = spark.createDataFrame([(dt.date(2015, 1, 1), dt.date(2013, 1, 1))], "date_start date, date_end date")
    assert sorted(r["year"] for r in H.expand_years(df).collect()) == [2013, 2014, 2015]


def test_too_many_segments_fail(spark):
    df = spark.range(27).select(F.lit("s").alias("tmsid"), F.col("id").alias("date_start"))
    with pytest.raises(Exception, match="26"):
        H.assign_segment_id(df).collect()


def test_daily_to_annual_keeps_rows(spark):
    df = spark.range(1000).select(F.lit("A").alias("tmsid2"), F.lit("0").alias("tmsid"), F.date_add(F.lit("2023-06-01"), (F.col("id") % 400).cast("int")).alias("date"), F.col("id").cast("double").alias("pm10"), F.lit(None).cast("double").alias("pm25"))
    assert A.summarize_annual(df).agg(F.sum("n_rows")).first()[0] == 1000
    assert A.summarize_daily(df).agg(F.min("pm25_flag"), F.count("pm25")).first() == (1, 0)


def test_kernels_need_emission(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 9000.0)], "pid int, x double, y double")
    s = spark.createDataFrame([(10.0, 0.0, 5.0), (400.0, 0.0, 7.0)], "x double, y double, emission double")
    with pytest.raises(ValueError, match="emission"):
        X.kernel_sources(p, s.drop("emission"), "pid", 1000)
    got = {r["pid"]: r["emission"] for r in X.kernel_sources(p, s, "pid", 1000).collect()}
    assert 5 < got[1] < 7 and got[2] is None
    with pytest.raises(Exception, match="weights"):
        X.kernel_sources(p, s.withColumn("w", F.lit(-1.0)), "pid", 1000, weight="w").collect()


def test_far_points_find_their_road(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100_000.0, 0.0)], "pid int, x double, y double")
    r = spark.createDataFrame([(7, 10.0, 5.0, 10.0, -5.0), (8, 10.0, 5.0, 10.0, -5.0)], "link_id int, x1 double, y1 double, x2 double, y2 double")
    got = {x["pid"]: (x["link_id"], x["distance"]) for x in X.nearest_segment(p, r, "pid", "link_id", 4).collect()}
    assert got == {1: (7, 10.0), 2: (7, 99990.0)}


def test_missing_source_is_empty(spark, tmp_path):
    assert S.read_or_empty(spark, str(tmp_path / "none.parquet"), "a int").collect() == []
    assert S.read_site_history(spark, _csv(tmp_path)).first()["year"] == 2020


def _csv(tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text('tmsid,site_type,year,date_start,date_end,coords\n1,urban,2020,2020-01-01 00:00:00,,"36.1, 127.2"\n')
    return str(path)


def test_strict_numbers_fail_on_text(spark):
    from aerogrid.functions.columns import strict_double

    df = spark.createDataFrame([("1.5",), (None,)], "t string")
    assert [r[0] for r in df.select(strict_double("t")).collect()] == [1.5, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([("x",)], "t string").select(strict_double("t")).collect()


def test_tables(spark, line):
    K.save_table(line, "kept_line")
    K.save_table(line.limit(0), "kept_line", replace=False)
    assert spark.table("kept_line").count() == line.count()
    spark.sql("DROP TABLE kept_line")


def test_export_to_a_database(spark, line, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    K.write_jdbc(line, url, "line")
    back = spark.read.jdbc(url, "line")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, line.collect()), key=str)


def test_dates_by_position(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 9), ("a", 2)], "k string, i int")
    dates = spark.createDataFrame([("2024-01-02",), ("2024-01-01",), ("2024-01-02",)], "d string")
    got = {(r["k"], r["i"]): r["date"] for r in J.date_by_position(df, ["k"], ["i"], dates).collect()}
    assert got == {("a", 1): "2024-01-01", ("a", 2): "2024-01-02", ("a", 3): None, ("b", 9): "2024-01-01"}


def test_infinite_values_in_ranges(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (None,), (-3.0,)], "v double")
    got = A.range_report(df, ["v"]).first()
    assert (got["min"], got["max"]) == (-3.0, 1.0)


def test_latin_hypercube_fills_each_axis():
    got = M.latin_hypercube({"a": (0.0, 10.0), "b": (-3.0, 0.0)}, 10, powers=["b"])
    assert sorted(int(r["a"]) for r in got) == list(range(10))
    assert all(1e-3 <= r["b"] <= 1 for r in got)


def test_folds_without_groups_are_random(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert {r["fold"] for r in M.folds(df, None, "k").select("fold").distinct().collect()} == {0, 1, 2, 3, 4}
    assert M.folds(df, "grouped", "k", "absent").columns == ["k", "fold"]


def test_stream_equals_batch_late_rows_dropped(spark, tmp_path):
    from aerogrid.streaming.daily import read_stream, summarize_daily_stream

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(24 * 10)]
    spark.createDataFrame(rows, "id int, ts timestamp, v double").repartition(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = summarize_daily_stream(read_stream(spark, str(tmp_path / "in"), schema), "ts", [], ["v"])
    q = out.writeStream.outputMode("append").format("memory").queryName("daily_append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["date"].day: r["v"] for r in spark.table("daily_append").collect()}
    assert got[1] == sum(range(24)) / 24 and len(got) >= 7


def test_compare_full_fills_zero(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0)], "k int, v double")
    assert sorted(map(tuple, J.compare_full(a, b, ["k"], ["v"]).collect())) == [(1, 2.0, 0.0, -2.0), (2, 0.0, 3.0, 3.0)]
