"""One query for each text operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, quality
from .common import fold_of, table
from .decontaminate import decontaminate
from .hilbert_ann import search
from .jaccard_join import link_documents
from .lexical_search import search as rank_documents
from .lexical_search import search_sql
from .license_scan import scan_licenses, scan_licenses_sql
from .packing import pack
from .prefix_trie import prefix_trie, prefix_trie_sql, share_openings, turns_of
from .suffix_dedup import find_repeats
from .token_count import count_tokens
from .url_filter import filter_urls, filter_urls_sql


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated span; documents without any have none."""
    found = find_repeats(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("span"))
    return found.select("doc_id", "span.begin", "span.end", (F.col("span.end") - F.col("span.begin")).alias("n_words"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(share_openings(turns_of(table(spark, sf_dir, "conversations")))).drop("node_id", "parent_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan,
            op2_suffix_dedup,
            op3_line_dedup,
            op4_packing,
            op5_language_id,
            op6_hilbert_ann,
            op7_quality,
            op8_decontaminate,
            op9_token_count,
            op10_jaccard_join,
            op11_url_filter,
            op12_lexical_search,
            op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": scan_licenses_sql(),
        "op3_line_dedup": line_dedup.dedupe_lines_sql(),
        "op11_url_filter": filter_urls_sql(),
        "op12_lexical_search": search_sql(),
        "op13_prefix_trie": prefix_trie_sql(),
    }
