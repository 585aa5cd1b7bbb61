"""Tables laid out by place: windows equal plain filters, and read few files, whatever the data look like."""

import os

from pyspark.sql import functions as F

from aerogrid.sources.places import read_window, write_by_place
from aerogrid.sources.readers import window_read


def _files(path):
    return [f for f in os.listdir(f"{path}/rows") if f.endswith(".parquet")]


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_windows_of_a_town_and_of_one_place(spark, tmp_path):
    """A third of all rows at one place, a third in a town of one kilometre, the others over 100 km, one of them far off."""
    path = str(tmp_path / "t")
    i = F.col("id")
    x = F.when(i % 3 == 0, 5000.0).when(i % 3 == 1, 5000.0 + i * 7919 % 1000).otherwise(i * 6007 % 100_000 + 0.0)
    y = F.when(i % 3 == 0, 5000.0).when(i % 3 == 1, 5000.0 + i * 6101 % 1000).otherwise(i * 7001 % 100_000 + 0.0)
    df = spark.range(30_000).select(i, F.when(i == 2, 1e9).otherwise(x).alias("x"), y.alias("y"), F.lit("a").alias("place"), F.lit("b").alias("TIE"))
    write_by_place(df, path, rows=500)
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/boxes").collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 500
    assert _rows(spark.read.parquet(f"{path}/rows")) == _rows(df)
    for box, most in (((50_000, 60_000, 50_000, 60_000), 0.1), ((5200, 5400, 5200, 5400), 0.2), ((5000, 5000, 5000, 5000), 0.4), ((-9, -1, 0, 1e9), 0)):
        got = read_window(spark, path, *box)
        assert got.columns == df.columns
        assert _rows(got) == _rows(window_read(df, *box))
        assert len(got.inputFiles()) <= most * len(_files(path)), (box, len(got.inputFiles()), len(_files(path)))
    everything = read_window(spark, path, -1e12, 1e12, -1e12, 1e12)
    assert everything.count() == 30_000


def test_rows_without_a_place(spark, tmp_path):
    path = str(tmp_path / "t")
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1.0, -1e308, 1e308]
    df = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate((a, b) for a in values for b in values)] * 2, "x double, y double, file int")
    write_by_place(df, path, rows=10)
    assert _rows(spark.read.parquet(f"{path}/rows")) == _rows(df)
    for box in ((0, 1, 0, 1), (-1e308, 1e308, -1e308, 1e308), (0.5, float("inf"), 0, 2), (float("-inf"), float("inf"), 0, 0)):
        assert _rows(read_window(spark, path, *box)) == _rows(window_read(df, *box))


def test_empty_and_whole_numbers(spark, tmp_path):
    empty = spark.createDataFrame([], "x double, y double, n int")
    write_by_place(empty, str(tmp_path / "e"))
    assert read_window(spark, str(tmp_path / "e"), 0, 1, 0, 1).collect() == []
    cells = spark.range(4000).select((F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"), F.col("id").alias("value"))
    for _ in range(2):  # a table that is there is replaced
        write_by_place(cells, str(tmp_path / "c"), "col", "row", rows=250)
    got = read_window(spark, str(tmp_path / "c"), 10, 19, 10, 19, "col", "row")
    assert _rows(got) == _rows(window_read(cells, 10, 19, 10, 19, "col", "row")) and got.count() == 100
    assert len(got.inputFiles()) < len(_files(str(tmp_path / "c"))) / 2
