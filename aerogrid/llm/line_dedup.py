"""Line de-duplication by site-relative frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A line on more than this share of its host's pages is boilerplate, if it is on MIN_PAGES pages at least.
RATIO, MIN_PAGES = 0.05, 3
#: Boilerplate lines (eight bytes each) up to which the list is broadcast; beyond, hosts are joined by shuffle.
BROADCAST_LINES = 1_000_000


def dedupe_lines(
    docs: DataFrame,
    host: Column | str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    text_col: str = "text",
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with the text rid of boilerplate lines, and two columns more: n_lines and n_dropped.

    Lines are the parts between newlines; they are compared without spaces at their ends. Of each host's
    pages, exact copies count once. A line goes from all pages of the host if the share of pages that hold it
    exceeds ratio and their number is min_pages at least; blank lines are neither counted nor dropped. A null text stays
    null with 0 lines; pages with a null host form one host with the empty name. Repeated rows are each cleaned. Other
    columns pass through, but columns named n_lines or n_dropped are replaced. An empty table stays empty.

    Only 64-bit hashes of lines are shuffled, summed before the shuffle, so a hot host or line is no hot task. With more than
    broadcast_lines boilerplate lines in all, rows are shuffled by host to meet their list; adaptive execution splits a hot host's.
    """
    spark_host = (F.col(host) if isinstance(host, str) else host).cast("string")
    site = F.coalesce(spark_host, F.lit(""))
    text = F.col(text_col)
    lines = F.split(text, "\n")
    solid = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    pages = (
        docs.select(site.alias("site"), F.xxhash64(text).alias("page"), F.transform(F.array_distinct(solid), lambda x: F.xxhash64(x)).alias("keys"))
        .filter(F.col("keys").isNotNull())
        .groupBy("site", "page")
        .agg(F.first("keys").alias("keys"))
    )
    pages = materialise(pages)
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    held = pages.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"))
    common = held.filter(F.col("n") >= min_pages).join(totals, "site")
    common = common.filter(F.col("n") > ratio * F.col("n_pages"))
    # at most (mean lines of a page) / ratio keys a host
    common = materialise(common.groupBy("site").agg(F.collect_list("key").alias("dropped_keys")))
    n_common = common.agg(F.sum(F.size("dropped_keys"))).first()[0] or 0
    if n_common <= broadcast_lines:
        common = F.broadcast(common)

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), site.alias("site"))
    joined = packed.join(common, "site", "left")
    body = F.col(f"row.`{text_col}`")
    parts = F.split(body, "\n")
    kept = F.when(F.col("dropped_keys").isNull(), parts).otherwise(
        F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains("dropped_keys", F.xxhash64(F.trim(x))))
    )
    joined = joined.select("row", kept.alias("kept"), parts.alias("parts"))
    return joined.select(
        *[(F.array_join("kept", "\n") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names],
        F.coalesce(F.size(F.filter("parts", lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("parts") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedupe_lines_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """doc_id, text, n_lines, n_dropped of the table documents, host being its source, as DuckDB SQL."""
    return f"""
    WITH parts AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS lines FROM documents),
    pages AS (SELECT DISTINCT site, text, lines FROM parts WHERE text IS NOT NULL),
    totals AS (SELECT site, count(*) AS n_pages FROM pages GROUP BY site),
    held AS (
      SELECT site, line, count(*) AS n FROM (
        SELECT site, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages
      ) GROUP BY site, line
    ), common AS (
      SELECT site, list(line) AS dropped FROM held JOIN totals USING (site)
      WHERE n >= {min_pages} AND n > {ratio}::DOUBLE * n_pages GROUP BY site
    ), cleaned AS (
      SELECT doc_id, lines, list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(dropped, []), trim(x))) AS kept
      FROM parts LEFT JOIN common USING (site)
    )
    SELECT doc_id, CASE WHEN lines IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
      coalesce(len(list_filter(lines, lambda x: trim(x) <> '')), 0)::BIGINT AS n_lines,
      coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
    FROM cleaned"""
