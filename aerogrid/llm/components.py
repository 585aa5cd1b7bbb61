"""Connected components of a table of links, by alternating stars, all in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _with_least(links: DataFrame, key: str, other: str) -> DataFrame:
    """links with m, the smallest `other` of each `key`.

    The smallest is found by partial aggregation; in the join a node of very many links is one row on the
    other side, so adaptive execution may split its links over tasks.
    """
    return links.join(links.groupBy(key).agg(F.min(other).alias("m")), key)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link; root is the smallest node of its component.

    Links may repeat, in either direction; loops and nulls are ignored. No links give no rows. Each round lets every node
    hand its larger neighbours to its smallest one, then every node point there itself; a component of
    diameter d takes about log d rounds. Each round's links are written, so lost executors repeat little.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter(F.col("u") < F.col("v")).distinct()
    edges = materialise(edges.select("u", "v"))
    before = _state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both, "u", "v")
        large = near.filter(F.col("v") > F.col("u")).select(F.col("v"), F.least("u", "m").alias("u"))
        large = large.filter(F.col("u") < F.col("v")).distinct()
        # u is the smaller end: for each larger node v, its smallest neighbour takes over the others
        joined = _with_least(large, "v", "u")
        small = joined.select("v", F.col("m").alias("u")).union(joined.select(F.col("u").alias("v"), F.col("m").alias("u")))
        shrunk = materialise(small.filter(F.col("u") < F.col("v")).distinct().select("u", "v"))
        discard(edges)
        edges, after = shrunk, _state(shrunk)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
