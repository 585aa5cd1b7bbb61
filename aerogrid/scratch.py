"""Tables in the shared folder that cut a plan, and joins that broadcast only what is small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which it is broadcast to a join; beyond, both sides are shuffled.
BROADCAST_BYTES = 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="aerogrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that goes when the application ends."""
    root = f"{shared_folder(spark)}/aerogrid-{spark.sparkContext.applicationId}"
    path, files = _path(spark, root)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: later steps don't compute it again, nor carry its plan."""
    name = new_path(df.sparkSession)
    df.write.parquet(name)
    out = df.sparkSession.read.schema(df.schema).parquet(name)
    out.scratch_table = name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more; other frames are left alone."""
    for df in tables:
        if name := getattr(df, "scratch_table", None):
            path, files = _path(df.sparkSession, name)
            files.delete(path, True)


def small(df: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """df, for broadcast if it is small: 32 bytes a row and row_bytes."""
    held = df.agg(F.sum(F.lit(32) if row_bytes is None else row_bytes + 32)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df
