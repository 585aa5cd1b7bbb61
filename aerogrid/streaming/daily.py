"""The daily summary as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None, only: str | None = None) -> DataFrame:
    """Parquet files of a folder as they come; `only` is a pattern of their names."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", only) if only else reader
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def summarize_daily_stream(df: DataFrame, time: str, keys: Sequence[str], values: Sequence[str], late: str = "2 days") -> DataFrame:
    """Daily means and flags of a stream, each day given once when its readings can no longer be late."""
    n = F.count(F.lit(1))
    flags = [((n < 18) | (F.count_if(F.col(v).isNull()) > 6)).cast("int").alias(f"{v}_flag") for v in values]
    days = df.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day"))
    out = days.agg(*[F.avg(v).alias(v) for v in values], *flags)
    return out.withColumn("date", F.to_date("window.start")).drop("window")
