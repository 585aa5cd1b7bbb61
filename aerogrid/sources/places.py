"""Tables laid out by place, of which a window is read from the few files that meet it.

Rows are written in the order of a key that interleaves the bits of x and y, a bounded number a file, so that a file
holds neighbours. Beside them lies a table of the files' boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import window_read

#: Bits of each axis in a key, and the masks that spread 26 bits over every other bit of 52.
BITS = 26
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(cell: Column) -> Column:
    for step, mask in SPREAD:
        cell = cell.bitwiseOR(F.shiftleft(cell, step)).bitwiseAND(F.lit(mask))
    return cell


def _cell(v: Column, low: float | None, high: float | None) -> Column:
    """Which of 2^BITS steps from low to high v lies in; halves keep the width finite for any two numbers."""
    width = (high or 0.0) / 2 - (low or 0.0) / 2
    share = (v / 2 - F.lit((low or 0.0) / 2)) / F.lit(width) if width > 0 else F.lit(0.0)
    return F.least(F.floor(share * (1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))


def _finite(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def place_key(x: Column, y: Column, box: tuple[float | None, ...]) -> Column:
    """The place of (x, y) along a curve through box (xmin, xmax, ymin, ymax); null if a coordinate is null or not finite."""
    xmin, xmax, ymin, ymax = box
    return _spread(_cell(_finite(x), xmin, xmax)).bitwiseOR(F.shiftleft(_spread(_cell(_finite(y), ymin, ymax)), 1))


def write_by_place(df: DataFrame, path: str, x: str = "x", y: str = "y", rows: int = 2_000_000, group_bytes: int = 16 << 20) -> None:
    """Write df for read_window: at most `rows` rows a file and about group_bytes a row group, neighbours together.

    All rows and columns are kept, whatever their names; those with a null or non-finite coordinate share files of their own
    or lie before the others. Many rows of one place are dealt to several files. An empty table is one without files to
    read. df is gone over three times (extent, bounds of the ranges, writing), so cut() it before if it is dear to make.
    A table that is there is replaced.
    """
    at = [_finite(F.col(c)) for c in (x, y)]
    found = df.agg(*[f(c) for c in at for f in (F.min, F.max)], F.count(F.lit(1))).first()
    key, tie = _new_names(df, "place", "tie")
    keyed = df.withColumn(key, place_key(F.col(x), F.col(y), tuple(found)[:4])).withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    files = max(1, -(-5 * found[4] // (4 * rows)))  # four fifths full: bounds of ranges are estimates, and fuller files are split
    ordered = keyed.repartitionByRange(files, key, tie).sortWithinPartitions(key).drop(key, tie)
    writer = ordered.write.mode("overwrite").option("maxRecordsPerFile", rows).option("parquet.block.size", group_bytes)
    writer.parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    bounds = [f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"{f.__name__}_{n}") for c, n in ((x, "x"), (y, "y")) for f in (F.min, F.max)]
    boxes = written.groupBy(written.metadataColumn("_metadata")["file_name"].alias("file")).agg(*bounds, F.count(F.lit(1)).alias("n"))
    boxes.coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")


def read_window(spark: SparkSession, path: str, xmin: float, xmax: float, ymin: float, ymax: float, x: str = "x", y: str = "y") -> DataFrame:
    """The rows inside a rectangle of a table of write_by_place: only files whose box meets it are opened.

    Their names pass through the driver, as those of any table's files do. Within them the comparisons reach the row groups.
    Rows without a coordinate are in no window.
    """
    meets = (F.col("max_x") >= xmin) & (F.col("min_x") <= xmax) & (F.col("max_y") >= ymin) & (F.col("min_y") <= ymax)
    names = [r["file"] for r in spark.read.parquet(f"{path}/boxes").filter(meets).select("file").collect()]
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema)
    return window_read(spark.read.schema(schema).parquet(*[f"{path}/rows/{n}" for n in sorted(names)]), xmin, xmax, ymin, ymax, x, y)


def _new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
