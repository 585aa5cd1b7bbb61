"""Readers: readings, site histories, vector layers, rasters as cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import null_sentinel

POLLUTANTS = ("so2", "co", "o3", "no2", "pm10", "pm25")

#: Columns of the site history and of raster cells.
SITE_HISTORY = "tmsid string, site_type string, year int, date_start timestamp_ntz, date_end timestamp_ntz, coords string"
CELLS = "row int, col int, value double"


def clean_measurements(raw: DataFrame, time: str = "ts", hours: int = 9, values: Sequence[str] = ("pm10", "pm25")) -> DataFrame:
    """Hourly readings: the clock shifted to local time, its date, and negative readings null."""
    local = F.col(time) + F.expr(f"INTERVAL {int(hours)} HOURS")
    df = raw.withColumn("datehour", local).withColumn("date", F.to_date("datehour"))
    return null_sentinel(df, [v for v in values if v in raw.columns])


def read_measurements(spark: SparkSession, path: str, time: str = "ts", hours: int = 9) -> DataFrame:
    return clean_measurements(spark.read.parquet(path), time, hours, POLLUTANTS)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet") -> DataFrame:
    """The table at path, or no rows of the schema if nothing is there."""
    try:
        return spark.read.format(format).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_site_history(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    reader = spark.read.format(format).schema(SITE_HISTORY)
    return (reader.option("header", True) if format == "csv" else reader).load(path)


def read_original_sites(spark: SparkSession, path: str) -> DataFrame:
    """Register of first coordinates; empty coordinate text becomes null."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("double") for c in ("longitude", "latitude")})


def read_weather(spark: SparkSession, path: str, values: Sequence[str], missing: float = -990.0, scale: float = 1.0) -> DataFrame:
    """Station weather: values at or below the mark of missing ones are null, the others are scaled."""
    df = spark.read.parquet(path)
    return df.withColumns({v: F.when(F.col(v) > missing, F.col(v) * scale) for v in values})


def parse_wkt(col: str) -> Column:
    """ARRAY<STRUCT<x, y>> of the coordinate pairs of POINT, LINESTRING or one-ring POLYGON text.

    Text of several rings or parts fails the job: shapes.wkt_rings and wkt_edges read it.
    """
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    pairs = F.regexp_extract_all(F.col(col), F.lit(f"({number}\\s+{number})"), F.lit(1))
    several = F.raise_error(F.concat(F.lit("a geometry of several rings or parts: "), F.substring(F.col(col), 1, 60)))
    pairs = F.when(F.col(col).rlike(r"\)\s*,\s*\("), several).otherwise(pairs)
    return F.transform(
        pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y"))
    )


def read_features(spark: SparkSession, path: str, wkt: str | None = None) -> DataFrame:
    """A vector layer's attributes; a WKT column also becomes a ring."""
    df = spark.read.parquet(path)
    return df.withColumn("ring", parse_wkt(wkt)) if wkt else df


def read_raster_cells(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("value", F.when(F.col("value") != nodata, F.col("value"))) if nodata is not None else df


def with_name_date(df: DataFrame, pattern: str = r"(\d{7})", name: Column | None = None, form: str = "yyyyDDD") -> DataFrame:
    """Date (and year) written in the name of the file that a row came from."""
    text = F.regexp_extract(F.input_file_name() if name is None else name, pattern, 1)
    df = df.withColumn("name_date", F.try_to_timestamp(text, F.lit(form)).cast("date"))
    return df.withColumn("name_year", F.year("name_date"))


def read_partitions(spark: SparkSession, glob: str, pattern: str, form: str) -> DataFrame:
    """All files of a glob, each row with the date in its file's name."""
    return with_name_date(spark.read.parquet(glob), pattern, form=form)


def layers_to_long(df: DataFrame, values: str, start: str) -> DataFrame:
    """A row for each layer: ts is the start plus the layer's number in hours."""
    keep = [c for c in df.columns if c not in (values, start)]
    long = df.select(*keep, F.col(start).alias("_start"), F.posexplode(values).alias("_hour", "value"))
    return long.withColumn("ts", F.col("_start") + F.make_dt_interval(hours=F.col("_hour"))).drop("_start", "_hour")


def window_read(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a rectangle, by plain comparisons that reach a Parquet scan."""
    return df.filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def query_tables(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over DataFrames named in braces, without importing them anywhere."""
    return spark.sql(sql, **tables)
