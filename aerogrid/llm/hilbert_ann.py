"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on a few directions, several times over with other directions and shifts; each time their
Hilbert keys put all rows in one order. What lies near a query in some order is a candidate, and candidates are ranked by
their cosine on the original vectors. Orders are cut into blocks of equally many rows, so a hot vector fills no one
block, and how far a query looks along an order is set from a sample of queries that are searched exhaustively.

With many directions an order is one of sign patterns first, and each agreement of a sign tells a little; many such orders with
short windows find more of the neighbours, for fewer candidates, than a few orders of few directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, materialise, struct

#: Orders, directions of each, and bits that a key has at most.
CURVES, DIRECTIONS, KEY_BITS = 48, 16, 48
#: Rows that directions are fitted on, and queries that are searched exhaustively to set the reach, at most (about).
FIT_ROWS, TUNE_QUERIES = 4096, 96
#: The share of the sample's true neighbours that the reach must take in, and rows of a block of an order.
TARGET, BLOCK = 0.95, 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of whole numbers below 2**bits; rows * bits at most 63.

    From the highest bit down, the curve inside a cell is that of the whole, reflected and with axes exchanged:
    undoing these level by level leaves, read across the axes, the Gray code of the place.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> level & 1
    return key


class Curves(NamedTuple):
    """Directions (curve, axis, dimension), and the range of each projection with its shift."""

    directions: np.ndarray
    low: np.ndarray
    scale: np.ndarray

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        bits = max(1, min(15, KEY_BITS // self.directions.shape[1]))
        at = (unit @ self.directions[curve].T - self.low[curve]) * self.scale[curve]
        return hilbert_keys(np.clip(at * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def fit_curves(sample: np.ndarray, curves: int, dims: int, seed: int = 7) -> Curves:
    """Directions drawn more often where the sample spreads wider; three deviations to both sides of the mean, shifted at random."""
    rng = np.random.default_rng(seed)
    axes = min(DIRECTIONS, dims)
    spread = np.linalg.cholesky(np.cov(sample.T).reshape(dims, dims) + 1e-9 * np.eye(dims)) if len(sample) > 1 else np.eye(dims)
    directions = np.empty((curves, axes, dims))
    for c in range(curves):
        drawn, _ = np.linalg.qr(spread @ rng.standard_normal((dims, axes)))
        directions[c] = drawn.T
    at = np.einsum("nd,cad->can", sample, directions) if len(sample) else np.zeros((curves, axes, 1))
    width = np.maximum(at.std(axis=2), 1e-9) * 6
    return Curves(directions, at.mean(axis=2) + width * (rng.uniform(-0.025, 0.025, width.shape) - 0.5), 1 / width)


def _vectors(raws: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype("f8")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and always summed in one order."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _best(query: np.ndarray, query_id: int, rows: np.ndarray, unit: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query, row, cosine) of the k best rows but the query itself; ties to the smaller id."""
    close = unit @ (query / np.sqrt((query * query).sum()))
    close[ids == query_id] = -np.inf
    open_ = np.flatnonzero(np.isfinite(close))
    if len(open_) > k:
        cut = np.partition(close[open_], -k)[-k]
        open_ = open_[close[open_] >= cut - 1e-12]
    exact = _cosines(np.broadcast_to(query, (len(open_), len(query))), rows[open_])
    best = np.lexsort((ids[open_], -exact))[:k]
    return [(int(query_id), int(ids[open_[b]]), float(exact[b])) for b in best]


_FOUND = struct(("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id and the vector's numbers as bytes, and their numpy type; without vectors that are null, zero or not finite throughout."""
    held = table.schema[vector_col].dataType
    single = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)
    kind, of = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(of).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if None in v:
                    continue
                a = np.array(v, kind)
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    raws.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], names=["vec_id", "v"])

    return map_batches(rows, run, struct(("vec_id", T.LongType()), ("v", T.BinaryType()))), kind


def exhaustive(rows: DataFrame, queries: pd.DataFrame, k: int, kind: str) -> DataFrame:
    """The true neighbours of a bounded set of queries, which is broadcast to all rows."""
    spread = rows.sparkSession.sparkContext.broadcast((queries["vec_id"].to_numpy(np.int64), [bytes(v) for v in queries["v"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws = spread.value
        asked = _vectors(raws, kind) if raws else []
        for batch in batches:
            if batch.num_rows and len(ids):
                held, held_ids = _vectors(batch.column(1).to_pylist(), kind), batch.column(0).to_numpy()
                unit = _unit(held)
                found = [x for q, i in zip(asked, ids, strict=True) for x in _best(q, i, held, unit, held_ids, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=_FOUND.names)

    return _top(map_batches(rows, run, _FOUND), k)


def _ordered(rows: DataFrame, made: Curves, kind: str) -> DataFrame:
    """curve, place, vec_id, candidate, query: all rows in each curve's order; place counts the candidates before a row.

    Only keys and ids are sorted, by ranges of (curve, key, id): equal keys are dealt out by id.
    """
    spark = rows.sparkSession
    spread, curves = spark.sparkContext.broadcast(made), len(made.directions)
    keyed_as = struct(("curve", T.IntegerType()), ("key", T.LongType()), ("vec_id", T.LongType()), ("row", T.LongType()), ("candidate", T.BooleanType()), ("query", T.BooleanType()))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_vectors(batch.column(1).to_pylist(), kind))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), c, np.int32)), pa.array(spread.value.keys(unit, c)), batch.column(0), *batch.columns[2:]], names=keyed_as.names)

    keyed = map_batches(rows.select("vec_id", "v", "row", "candidate", "query"), key, keyed_as)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * curves // 1_000_000))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "vec_id", "row").sortWithinPartitions("curve", "key", "vec_id", "row").drop("key")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, curve, at = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            of, held = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            places = np.empty(len(of), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if of[a] != curve:
                    curve, at = of[a], 0
                before = at + np.cumsum(held[a:b])
                places[a:b] = before - held[a:b]
                at = int(before[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part, np.int32)), pa.array(places)], names=[*batch.schema.names, "part", "place"])

    numbered_as = T.StructType([f for f in keyed_as if f.name != "key"] + struct(("part", T.IntegerType()), ("place", T.LongType())).fields)
    numbered = materialise(map_batches(ordered, number, numbered_as))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("curve", "part").agg(F.count_if("candidate").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = F.broadcast(starts.select("curve", "part", "start"))  # a row for each task and curve
    return numbered.join(starts, ["curve", "part"]).withColumn("place", F.col("place") + F.col("start")).drop("part", "start")


def _reach(rows: DataFrame, ordered: DataFrame, k: int, target: float, least: int, kind: str) -> int:
    """How far a query must look along the orders so that `target` of a sample's true neighbours are in reach."""
    queries = rows.filter("query")
    share = min(1.0, TUNE_QUERIES / max(1, queries.count()))
    tuned = queries.filter(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(1 << 20)) < share * (1 << 20)).select("vec_id", "v").limit(2 * TUNE_QUERIES).toPandas()
    true = exhaustive(rows.filter("candidate").select("vec_id", "v"), tuned, k, kind).select("query_id", "vec_id").toPandas()
    ids = sorted({*map(int, true["query_id"]), *map(int, true["vec_id"])})
    if not ids:
        return least
    placed = ordered.filter(F.col("vec_id").isin(ids)).groupBy("curve", "vec_id").agg(F.min("place").alias("place")).toPandas()  # few ids
    both = true.merge(placed.rename(columns={"vec_id": "query_id", "place": "q"}), on="query_id").merge(placed, on=["curve", "vec_id"])
    away = (both["place"] - both["q"]).abs().groupby([both["query_id"], both["vec_id"]]).min()
    return max(least, int(np.quantile(away, target, method="higher")) + 1)


def search(
    table: DataFrame,
    queries_every: int = 50,
    k: int = 5,
    curves: int = CURVES,
    block: int = BLOCK,
    target: float = TARGET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """Per query and neighbour: query_id, rank (from 1), vec_id, score (the cosine in double precision).

    Queries are the rows whose id is divisible by queries_every, candidates all rows but the query's own id. Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors must
    have one length. Of equal vectors only the k + 1 smallest ids can be among a query's k nearest (ties go to
    the smaller id), so only those are candidates. Rows that repeat an id with other vectors are candidates, and queries, each; a
    pair of ids counts once, with its largest cosine. Fewer candidates than k give fewer rows; an empty table gives none.

    A query is scored against the rows of its windows alone: at most 2 * reach for each curve, which goes into `report`
    with the number of candidates.
    """
    rows, kind = usable_vectors(table, id_col, vector_col)
    rows = materialise(rows.distinct().withColumn("query", F.pmod(F.col("vec_id"), F.lit(queries_every)) == 0))
    # the filter on the rank alone lets Spark cut a hot vector's group before it is shuffled
    first = Window.partitionBy("v").orderBy("vec_id")
    held = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).select("vec_id", "v", F.lit(True).alias("candidate"), F.lit(False).alias("query"))
    asks = rows.filter("query").select("vec_id", "v", F.lit(False).alias("candidate"), F.lit(True).alias("query"))
    both = materialise(held.union(asks).withColumn("row", F.monotonically_increasing_id()))
    discard(rows)
    total = both.filter("candidate").count()
    if total == 0:
        return both.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    sample = both.filter("candidate").filter(h < min(1.0, FIT_ROWS / total) * (1 << 20)).select("v").limit(2 * FIT_ROWS).toPandas()
    dims = _vectors([bytes(both.first()["v"])], kind).shape[1]
    fitted = _unit(_vectors([bytes(v) for v in sample["v"]], kind)) if len(sample) else np.zeros((0, dims))
    ordered = _ordered(both, fit_curves(fitted, curves, dims), kind)
    reach = _reach(both, ordered, k, target, 4 * k, kind)
    if report is not None:
        report |= {"reach": reach, "candidates": total, "share": min(1.0, 2 * reach * curves / total)}

    first, last = F.floor((F.col("place") - reach) / block), F.floor((F.col("place") + reach) / block)
    asked = ordered.filter("query").withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    dealt = asked.unionByName(ordered.filter("candidate").withColumn("block", F.floor(F.col("place") / block)))
    dealt = dealt.select("curve", "block", "query", "place", "row").join(both.select("row", "vec_id", "v"), "row").drop("row")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("place")
        if not len(q) or not len(c):
            return pd.DataFrame(columns=_FOUND.names)
        held, ids, places = _vectors(list(c["v"]), kind), c["vec_id"].to_numpy(), c["place"].to_numpy()
        unit, found = _unit(held), []
        low, high = np.searchsorted(places, q["place"].to_numpy() - reach), np.searchsorted(places, q["place"].to_numpy() + reach)
        for v, i, a, b in zip(_vectors(list(q["v"]), kind), q["vec_id"], low, high, strict=True):
            if a < b:
                found += _best(v, i, held[a:b], unit[a:b], ids[a:b], k)
        return pd.DataFrame(found, columns=_FOUND.names)

    found = dealt.groupBy("curve", "block").applyInPandas(rank, _FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
