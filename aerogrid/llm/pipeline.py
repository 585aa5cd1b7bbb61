"""The stages of the corpus pipeline.

Each takes the documents that the stage before kept and returns those it keeps, with the columns of documents; the last
returns packed pieces. Empty tables pass through, and other columns are carried along whatever their names. Decisions belong to
texts (of near copies: to a text with its id), not to ids: rows without an id, and rows that share one, are each judged by
their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup
from .common import discard, materialise, small, table
from .decontaminate import decontaminate
from .jaccard_join import link_documents
from .packing import pack
from .queries import tokenizer

#: A document whose language is less certain than this, or that has no letter, is rejected.
LEAST_SCORE = 0.5


def _text() -> Column:
    """What names a text: two 64-bit hashes."""
    return F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("text"), "text").alias("k2"))


def _row() -> Column:
    """What names a text with its id, in the order of ids; rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _text().alias("text"))


def _as_id(docs: DataFrame, name: Column) -> DataFrame:
    return docs.select(name.alias("doc_id"), "text")


def _drop(docs: DataFrame, name: Column, gone: DataFrame) -> DataFrame:
    """The rows of docs whose name isn't among those in gone (one column)."""
    gone = materialise(gone.toDF("aerogrid_gone").distinct())
    return docs.join(small(gone), name == F.col("aerogrid_gone"), "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found with some certainty.

    Null texts, empty ones and those without letters have no language and go. Without any labelled language all go.
    Copies are judged alike.
    """
    found = language_id.identify(_as_id(docs, _text()), language_id.fit(docs))
    return _drop(docs, _text(), found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select("doc_id"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rid texts of the lines that much of their source shares; documents left without text by that go.

    Null and empty texts have no lines and stay as they are. Copies are cleaned alike; a null source is a source of its own.
    n_chars is counted anew.
    """
    rest = [c for c in docs.columns if c not in ("text", "source")]
    packed = docs.select("text", "source", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("aerogrid_row"))  # the operator's own counts mustn't meet their names
    out = line_dedup.dedupe_lines(packed)
    out = out.filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    found = {"text": F.col("text"), "source": F.col("source"), "n_chars": n_chars}
    return out.select(*[found.get(c, F.col(f"aerogrid_row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at 0.8: that of the smallest id.

    Rows without an id stay only where no row of the group has one. Of rows that repeat both id and text one stays. Null, empty
    and blank texts link with nothing, but repeated rows of them count once too.
    """
    linked = materialise(link_documents(_as_id(docs, _row()), 5, 80))
    kept = _drop(docs, _row(), linked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    repeated = linked.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    discard(linked)
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay; copies are judged alike. With an empty benchmark all stay.
    """
    found = decontaminate(_as_id(docs, _text()), table(spark, sf_dir, "benchmark"))
    return _drop(docs, _text(), found.filter("contaminated").select("doc_id"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048; null and empty texts are their end token, rows that repeat are packed each."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack_windows),
]
