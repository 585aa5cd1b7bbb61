"""Series that are long, quantiles and places of whole tables, sites with many stays."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import joins as J
from aerogrid.operators import ranks as R
from aerogrid.operators import series as W


def test_one_series_of_many_rows_is_filled_in_one_go(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 997 == 5, F.col("id").cast("double")).alias("v"))
    began = time.time()
    got = W.fill_down_up(df, ["k"], ["id"], ["v"]).agg(F.sum("v"), F.count("v")).first()
    assert time.time() - began < 20
    at = np.arange(n)
    assert got[1] == n and got[0] == np.where(at < 5, 5, at - (at - 5) % 997).sum()


def test_interpolation_of_many_rows(spark):
    n = 100_000
    day = F.timestamp_seconds(F.col("id") * 3600)
    df = spark.range(n).select(F.lit("a").alias("k"), day.alias("t"), F.col("id"), F.when(F.col("id") % 500 == 0, F.col("id").cast("double")).alias("v"))
    began = time.time()
    off = W.interpolate_linear(df, ["k"], "t", ["v"]).agg(F.max(F.abs(F.col("v") - F.least("id", F.lit(n - n % 500 - (500 if n % 500 == 0 else 0)))))).first()[0]
    assert off == pytest.approx(0, abs=1e-6) and time.time() - began < 20


@pytest.mark.parametrize("few", [3, 100_000])
def test_quantiles_of_many_groups(spark, few):
    rng, shares = np.random.default_rng(few), (0.0, 0.25, 0.5, 0.75, 1.0)
    groups = {
        "a": rng.normal(size=501), "b": rng.integers(0, 4, 400).astype(float), "c": np.array([1.0, 9.0]), "d": np.full(90, 2.0), None: np.exp(rng.normal(0, 9, 300)),
        "f": np.array([5.0]), "g": np.array([-1e307, 1e307] * 30), "h": 5e-324 * rng.integers(0, 3, 60), "i": np.array([]),
    }
    rows = [(g, float(v), -float(v) if i % 3 else None) for g, vs in groups.items() for i, v in enumerate(vs)] + [("i", None, None), ("i", math.nan, math.inf), ("a", -math.inf, None)]
    df = spark.createDataFrame(rows, "value string, v double, w double").repartition(3)
    out = R.group_quantiles(df.withColumnRenamed("value", "g"), ["g"], ["v", "w"], shares, most=few, bins=50)
    got = {(r["g"], r["col"], r["share"]): r["value"] for r in out.collect()}
    for g, vs in groups.items():
        for col, held in (("v", vs), ("w", np.array([-v for i, v in enumerate(vs) if i % 3]))):
            for s in shares:
                assert (g, col, s) not in got if not len(held) else got.pop((g, col, s)) == pytest.approx(np.quantile(held, s), rel=1e-12)
    assert not got
    whole = np.concatenate(list(groups.values()))
    whole = {r["share"]: r["value"] for r in R.group_quantiles(df, [], ["v"], shares, most=few, bins=50).collect()}, whole
    assert all(whole[0][s] == pytest.approx(np.quantile(whole[1], s)) for s in shares)
    assert R.group_quantiles(df.limit(0), [], ["v"], shares).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_places_of_a_whole_table(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [(None, 3)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(4)
    got = {r["id"]: r["place"] for r in R.with_rank(df, ["v", "id"], "place", parts).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    assert got == {i: n for n, (i, _) in enumerate(order)}
    assert R.with_rank(df.limit(0), ["v"]).count() == 0


def test_fences_of_several_columns(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i) for i in range(9)] + [("a", 100.0, None), ("b", None, 1.0), (None, 50.0, 50.0)], "k string, v double, w double")
    got = {(r["k"], r["v"]): (r["v2"], r["w2"]) for r in W.winsorise(df, ["v", "w"], 1.0, ["k"], into=["v2", "w2"]).collect()}
    top = np.quantile([*range(9), 100], 0.75) + (np.quantile([*range(9), 100], 0.75) - np.quantile([*range(9), 100], 0.25))
    assert got["a", 100.0] == (pytest.approx(top), None) and got["b", None] == (None, 1.0) and got[None, 50.0] == (50.0, 50.0)
    assert W.winsorise(spark.createDataFrame([(None,)], "v double"), "v", 1.5).collect() == [(None,)]


def test_a_site_with_many_stays(spark):
    """100,000 stays of one site, and one of all its years: a reading meets the stays of its own stretch of days."""
    day = lambda n: F.date_add(F.lit("1990-01-01").cast("date"), n)
    stays = spark.range(100_000).select(F.lit("s").alias("k"), F.col("id").alias("stay"), day((F.col("id") % 9000).cast("int")).alias("date_start"), day((F.col("id") % 9000 + F.col("id") % 3).cast("int")).alias("date_end"))
    stays = stays.unionByName(stays.limit(1).withColumns({"stay": F.lit(-1).cast("long"), "date_start": day(0), "date_end": day(9000)}))
    stays = stays.unionByName(stays.limit(2).withColumn("date_end", F.lit(None).cast("date")))
    binned, width = J.in_bins(stays, F.col("date_start"), F.col("date_end"))
    most, total = binned.groupBy("k", "_bin").count().agg(F.max("count"), F.sum("count")).first()
    assert width == 3 and most < 100 and total < 3 * 100_001
    readings = spark.createDataFrame([(0, "s", 4000), (1, "s", 9), (2, "t", 9), (3, "s", None), (4, "s", 20_000)], "rid int, k string, n int").withColumn("date", day(F.col("n")))
    got = {}
    for r in J.interval_join(readings, stays, "k").collect():
        got.setdefault(r["rid"], set()).add(r["stay"])
    want = lambda n: {-1} | {i for i in range(100_000) if i % 9000 <= n <= i % 9000 + i % 3}
    assert got == {0: want(4000), 1: want(9)}
    assert sorted(r["rid"] for r in J.interval_join(readings, stays, "k", how="left_semi").collect()) == [0, 1]
    assert J.interval_join(readings, stays.limit(0), "k").count() == 0
