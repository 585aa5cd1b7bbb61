"""Medians of cells from counts of equal values."""

import re

import pytest
from pyspark.sql import functions as F

from aerogrid.operators import raster


@pytest.mark.parametrize("skip_na", [True, False])
def test_equal_values_are_counted_before_medians(spark, skip_na):
    i = F.col("id")
    cells = spark.range(40_000).select((i % 20).cast("int").alias("row"), (i % 300).cast("int").alias("col"), F.when((i % 300 > 9) | (i % 7 > 0), F.when(i % 300 != 299, (i * 31 % 23).cast("double"))).alias("value"))
    got = raster.cell_median(cells, ["row", "col"], skip_na)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[row[^\]]*, col[^\]]*, [^\]]*value[^\]]*\], functions=\[(partial_)?count\(1\)", plan)
    assert got.columns == ["row", "col", "value"]
    held = {}
    for r in cells.collect():
        held.setdefault((r["row"], r["col"]), []).append(r["value"])
    assert len(held) == 300

    def middle(values):
        known = sorted(v for v in values if v is not None)
        if not known or (not skip_na and len(known) < len(values)):
            return None
        return (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2

    assert {(r["row"], r["col"]): r["value"] for r in got.collect()} == {k: middle(v) for k, v in held.items()}
