"""Writers. Each writes in parallel; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def copy_query(spark, sql: str, path: str, **tables: DataFrame) -> None:
    """Write the rows of a query."""
    spark.sql(sql, **tables).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, replace: bool = True) -> None:
    """A catalogue table: replaced, or left as it is if it is there."""
    df.write.mode("overwrite" if replace else "ignore").saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, name: str, connections: int = 8, rows: int = 10_000, **properties: str) -> None:
    """A database's table, replaced: over so many connections at once at most, so many rows a statement."""
    df.write.mode("overwrite").option("numPartitions", connections).option("batchsize", rows).jdbc(url, name, properties=properties)


def write_surfaces(df: DataFrame, path: str) -> None:
    """Prediction surfaces (x, y, value), a folder for each outcome and year."""
    df.select("outcome", "year", "x", "y", "value").write.mode("overwrite").partitionBy("outcome", "year").parquet(path)


def class_bands(df: DataFrame, classes: Sequence[int], empty: float | None = 0.0) -> DataFrame:
    """One column class_NN for each class and one row for each cell, of (row, col, class, value)."""
    names = [f"class_{c:02d}" for c in classes]
    wide = df.withColumn("band", F.format_string("class_%02d", F.col("class"))).groupBy("row", "col").pivot("band", names).agg(F.first("value"))
    return wide.fillna(empty, names) if empty is not None else wide


def write_by_class(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("class").parquet(path)


def write_best(params: DataFrame, path: str) -> None:
    """The one row of best parameters as JSON."""
    params.coalesce(1).write.mode("overwrite").json(path)
