"""The tables that queries read, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import view


class Tables:
    """t.events, t.measurements, ...: given or derived tables under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)
