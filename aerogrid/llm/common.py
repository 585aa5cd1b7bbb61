"""Helpers that the text operators share: scratch tables, word splitting, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, discard, small
from ..session import ship_package

__all__ = [
    "WORD", "ascii_words", "blank_words", "discard", "fold_of", "lower_ascii", "map_batches", "materialise", "raw_texts", "small", "small_batches", "struct", "table", "text_input",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: letters and digits of ASCII, and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ASCII = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def ascii_words(raw: bytes) -> list[bytes]:
    """The ``WORD`` matches of UTF-8 text after lower-casing A-Z."""
    return raw.translate(_ASCII).split()


def blank_words(raw: bytes) -> list[bytes]:
    """Runs free of ASCII white space, after lower-casing A-Z."""
    return raw.lower().split()


def raw_texts(batch: pa.RecordBatch, name: str = "text", step: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, a few rows at a time; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    for i in range(0, len(col), step):
        for raw in col.slice(i, step).cast(kind).to_pylist():
            yield raw or b""


#: Rows of an Arrow batch, at most: texts are long, and whole batches stand in memory outside the heap.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_ROWS rows at most for what runs inside; the session's own setting is put back."""
    found = spark.conf.get(BATCH_CONF, "10000")
    spark.conf.set(BATCH_CONF, str(min(BATCH_ROWS, int(found)) if int(found) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, found)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """df.mapInArrow, with the package shipped. Of long texts, have it run inside small_batches, as materialise does."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:  # workers are used again, and Arrow would keep what it has freed
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def materialise(df: DataFrame) -> DataFrame:
    """cut() with small Arrow batches: df written as a Parquet table in the shared folder and read back.

    A lost executor then costs nothing that was finished, and later steps don't repeat the passes over the texts.
    """
    with small_batches(df.sparkSession):
        return cut(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that further columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def lower_ascii(text):
    """Lower-case A-Z alone; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(id_col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.coalesce(F.crc32(id_col.cast("string")) % n, F.lit(0))
