"""Every registered query of the station and raster operators, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import block_queries, model_queries, series_queries, shape_queries, spatial_queries
from .plans.tables import Tables
from .sources.fixtures import with_views

_ALL = {**series_queries.Q, **spatial_queries.Q, **shape_queries.Q, **block_queries.Q, **model_queries.Q}


def _bound(f) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
