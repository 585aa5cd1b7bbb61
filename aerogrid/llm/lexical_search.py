"""Ranked lexical search turned round: the items' terms are the index, and documents stream through it.

The items' terms become an inverted index that every task holds. A document's counts of those terms are looked up in it, which
gives its score for each item at once; a task keeps a bounded heap an item, and heaps are merged.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, WORD, ascii_words, discard, lower_ascii, map_batches, materialise, raw_texts, struct, text_input

#: Postings (an item's term) of one index; more items are searched for in several blocks, each against all documents.
BLOCK_POSTINGS = 1_000_000
#: Scores (documents x items) that a task computes at once.
CELLS = 2_000_000
#: Heaps of an item are merged in so many groups first.
GROUPS = 64
#: The whole-number form of the weight of a term that a document of m (of 100) its usual length holds tf times.
UNIT, TF_PART, M_PART, M_LEAST, M_LENGTH = 1_000_000_000, 1000, 8, 10, 90

_NONE = np.iinfo(np.int64).max


class Index:
    """Postings by term: numbers of the items that hold it."""

    def __init__(self, pairs: list[tuple[int | None, str]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        numbers = {i: j for j, i in enumerate(self.items)}
        self.terms: dict[bytes, int] = {}
        rows = sorted((self.terms.setdefault(t.encode(), len(self.terms)), numbers[i]) for i, t in pairs)
        self.posted = np.array([j for _, j in rows], np.int64)
        self.size = np.bincount([t for t, _ in rows], minlength=len(self.terms)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
        """Summed parts by (document, item)."""
        size = self.size[term]
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.zeros(n_docs * len(self.items), np.int64)
        np.add.at(out, np.repeat(doc, size) * len(self.items) + self.posted[at], np.repeat(part, size))
        return out.reshape(n_docs, -1)


class Heaps:
    """The k best (score, id) of each item: higher scores first, equal ones by id, no id last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least, self.last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).min)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        better = (scores > self.least) | ((scores == self.least) & (ids[:, None] <= self.last) & (scores > 0))
        if len(scores) > self.k:  # what k of the same batch surpass needn't be looked at
            better &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        for d, i in zip(*map(np.ndarray.tolist, np.nonzero(better)), strict=True):
            heap, row = self.heaps[i], (int(scores[d, i]), -int(missing[d]), -int(ids[d]))
            if len(heap) < self.k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.k:
                self.least[i], self.last[i] = heap[0][0], -heap[0][2]


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n, terms, tfs of each text with a term: how many it has, and which of the index's how often. index: a broadcast Index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.terms
        for batch in batches:
            keep, n, ends, terms, tfs = [], [], [0], [], []
            for i, raw in enumerate(raw_texts(batch)):
                words = ascii_words(raw)
                if words:
                    held = Counter(words)
                    for w in held.keys() & known.keys():
                        terms.append(known[w])
                        tfs.append(held[w])
                    keep.append(i)
                    n.append(len(words))
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    schema = struct(("doc_id", T.LongType()), ("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.LongType())))
    return map_batches(docs, count, schema)


def _search_block(docs: DataFrame, index: Index, k: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    counts = materialise(term_counts(docs, shared))
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, length = total[0], total[1] or 1
    weight = np.zeros(len(index.terms), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the index has terms
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        heaps, step = Heaps(len(held.items), k), max(1, CELLS // len(held.items))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids, n, terms, tfs = (batch.column(j) for j in range(4))
                sizes = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                m = np.array([M_LEAST + M_LENGTH * x * n_docs // length for x in n.to_pylist()], np.int64)
                term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                part = weight[term] * (UNIT * tf // (TF_PART * tf + M_PART * m[doc]))
                heaps.add(held.scores(doc, term, part, batch.num_rows), ids.fill_null(_NONE).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        found = [(held.items[i], s, None if none else -key) for i, heap in enumerate(heaps.heaps) for s, none, key in heap]
        cols = list(zip(*found, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "score", "doc_id"])

    best = map_batches(counts, score, struct(("item_id", T.LongType()), ("score", T.LongType()), ("doc_id", T.LongType())))
    for keys in (["item_id", "part"], ["item_id"]):
        by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("part", F.spark_partition_id() % GROUPS) if len(keys) > 1 else best
        best = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    out = materialise(best.select("item_id", "rank", "doc_id", "score"))
    discard(counts)
    shared.unpersist()
    return out


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item, of those that score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document's score for an item sums, over the
    item's different terms, the term's weight (rarer in documents: more) times a share that grows with the term's count and falls with the document's
    length, in whole numbers. Equal scores go by ascending id, documents without an id come last. Each row of docs is a document,
    repeated rows too, and may be listed once each; rows of items that share an id (null is one) are one item of all their terms. Null and empty texts
    have no term: such documents count nowhere, such items have no rows. Other columns don't matter. With an empty table on either side nothing is found.

    An index has at most about block_postings postings and is broadcast; more items are taken in blocks by hash, each against all documents. Each
    block reads the texts once. A task holds k rows an item, whatever it reads.
    """
    texts = text_input(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.regexp_extract_all(lower_ascii(F.col(item_text)), F.lit(f"({WORD})"), F.lit(1)).alias("terms"))
    wanted = materialise(wanted.select("item_id", F.explode("terms").alias("term")).distinct())
    n = wanted.count()
    blocks, out = -(-n // block_postings), None
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)) == b) if blocks > 1 else wanted
        pairs = [(r["item_id"], r["term"]) for r in block.toLocalIterator()]
        if pairs:
            found = _search_block(texts, Index(pairs), k)
            out = found if out is None else out.unionByName(found)
    discard(wanted)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def search_sql(k: int = 10) -> str:
    """The same rows for the tables documents and benchmark, as DuckDB SQL."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def low(text: str) -> str:
        return f"translate({text}, '{UPPER}', '{LOWER}')"

    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '{pattern}') AS words FROM documents WHERE text IS NOT NULL),
    held AS (SELECT rid, doc_id, words, len(words)::BIGINT AS n FROM texts WHERE len(words) > 0),
    total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM held),
    tfs AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, {low('unnest(words)')} AS term FROM held) GROUP BY rid, term),
    wanted AS (SELECT DISTINCT item_id, {low('unnest(words)')} AS term FROM (SELECT item_id, regexp_extract_all(text, '{pattern}') AS words FROM benchmark WHERE text IS NOT NULL)),
    weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
    scored AS (
      SELECT item_id, held.rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nl))))::BIGINT AS score
      FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN held ON held.rid = tfs.rid, total GROUP BY item_id, held.rid, doc_id
    ), ranked AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
