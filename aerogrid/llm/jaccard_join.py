"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct n-word shingles. All shingles have one order, the frequent ones last. Two sets of a
Jaccard similarity of t share a shingle among the first |x| - ceil(t|x|) + 1 of each; prefixes longer by l - 1 share l.
A document whose prefix would hold frequent shingles, and so meet many others, gets a longer prefix, and its
partners must share correspondingly more of it before the texts themselves are compared.

Links are wanted for their components, so a group of m copies isn't paired m * m times: each shingle first
names one leader that the others are compared with, in two rounds; only documents that are still in different
components are then compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, discard, map_batches, materialise, raw_texts, small, small_batches, struct
from .components import connected_components

#: Frequent shingles that the order puts last, at most; 16 bytes each are broadcast.
FREQUENT = 1 << 18
#: Shingles that a task counts at a time, and the count there from which it reports a shingle.
CHUNK, REPORTED = 2_000_000, 3
#: A document's longest prefix lengthening, and the summed frequency in its prefix at which lengthening begins.
LONGEST, COSTLY = 8, 64
#: Bits of a set's parity sketch, and words that a task keeps hashes of.
PARITY, KEPT = 512, 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; of fewer than n words the whole sequence, of none nothing."""
    words = blank_words(raw)
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > KEPT:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + len(h)]) * _A
        h ^= h >> np.uint64(32)
        h *= _B
    h ^= h >> np.uint64(29)
    return np.unique(h)


def set_id(s: np.ndarray) -> bytes:
    """A 128-bit hash of a whole set; it names the class of documents with that set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits, each telling whether an odd number of the set falls there: eight whole numbers.

    Two sketches differ in no more bits than their sets in elements.
    """
    odd = np.bincount((s >> np.uint64(7) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _least_overlap_col(x: Column, y: Column, percent: int) -> Column:
    """The intersection that sets of sizes x and y need: 100 i >= percent (x + y - i)."""
    return F.ceil((F.lit(percent) * (x + y)) / F.lit(100.0 + percent)).cast("int")


def frequent_shingles(docs: DataFrame, n: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents hold, sorted, and their counts.

    Counts come from all documents: tasks report what they have met REPORTED times a chunk, so a count can
    fall short by that much a chunk. They only order shingles; no result depends on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = WordHashes(), set(), [], 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= REPORTED
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"]
            )

        for batch in batches:
            for raw in raw_texts(batch):
                s = shingles(raw, n, hashes)
                key = set_id(s)
                if key not in seen:  # exact copies are one class later on
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield report()
                    seen, held, size = set(), [], 0
        if held:
            yield report()

    found = map_batches(
        docs.select(F.col(text_col).cast("string").alias("text")), count, struct(("token", T.LongType()), ("n", T.LongType()))
    )
    with small_batches(docs.sparkSession):
        top = found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_of(s: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A set's prefix in the common order, and how many of it partners of the same lengthening must share."""
    tokens, counts = frequent
    at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
    often = tokens[at] == s if len(tokens) else np.zeros(len(s), bool)
    rare, common, n = s[~often], s[often], counts[at[often]] if len(tokens) else np.zeros(0, np.int64)
    by = np.lexsort((common, n))
    need = -(-percent * len(s) // 100)
    length = len(s) - need + 1
    cost = int(n[by][: max(0, length - len(rare))].sum())
    more = 1
    while more < min(LONGEST, need) and cost >= COSTLY << (2 * (more - 1)):
        more += 1
    return np.concatenate([rare, common[by]])[: length + more - 1], more


def _sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_key, n, sid, more, prefix, parity."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n, text_col))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, ids, mores, prefixes, sketches = [], [], [], [], []
            for raw in raw_texts(batch):
                s = shingles(raw, n, hashes)
                prefix, more = prefix_of(s, percent, frequent.value) if len(s) else (s, 0)
                sizes.append(len(s))
                ids.append(set_id(s))
                mores.append(more)
                prefixes.append(prefix)
                sketches.append(parity(s))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int32()),
                    pa.array(ids, pa.binary()),
                    pa.array(mores, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n", "sid", "more", "prefix", "parity"],
            )

    out = struct(
        ("doc_id", rows.schema["doc_id"].dataType),
        ("text_key", T.LongType()),
        ("n", T.IntegerType()),
        ("sid", T.BinaryType()),
        ("more", T.IntegerType()),
        ("prefix", T.ArrayType(T.LongType())),
        ("parity", T.ArrayType(T.LongType())),
    )
    return map_batches(rows, run, out)


def _enough(x: str, y: str, percent: int) -> Column:
    """Whether two prefixes share as much as a link needs.

    Whatever two linked sets share beyond the shorter-reaching prefix is at most what that set has there, which is
    its least overlap less its lengthening; the rest must be shared inside the prefixes.
    """
    nx, ny, mx, my = (F.col(f"{s}.{c}") for c in ("n", "more") for s in (x, y))
    rest = F.greatest(F.ceil(nx * percent / 100.0) - mx, F.ceil(ny * percent / 100.0) - my)
    least = F.greatest(_least_overlap_col(nx, ny, percent) - rest, F.least(mx, my))
    return F.size(F.array_intersect(f"{x}.prefix", f"{y}.prefix")) >= least


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by their texts."""
    c = classes.select("cid", "n", "more", "prefix")
    close = pairs.join(c.alias("x"), F.col("a") == F.col("x.cid")).join(c.alias("y"), F.col("b") == F.col("y.cid"))
    close = materialise(close.filter(_enough("x", "y", percent)).select("a", "b"))
    wanted = close.select(F.col("a").alias("cid")).union(close.select(F.col("b").alias("cid"))).distinct()
    wanted = materialise(wanted.join(classes.select("cid", "sid", "text_key"), "cid"))
    text = F.col(text_col).cast("string")
    found = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(small(wanted), "text_key").select("cid", "sid", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keep = []
            for cid, sid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch), strict=True):
                new = cid not in seen and set_id(shingles(raw, n, hashes)) == sid
                keep.append(new)
                if new:
                    seen.add(cid)
            if len(seen) > 1_000_000:
                seen.clear()
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    texts = map_batches(found, once, struct(("cid", T.LongType()), ("text", T.StringType()))).groupBy("cid").agg(F.first("text").alias("text"))
    texts = materialise(texts)  # the joins then read plain tables, and a leader's many pairs can be split over tasks
    joined = (
        close.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), raw_texts(batch, "text_a"), raw_texts(batch, "text_b"), strict=True):
                if last[0] != b:
                    last = (b, shingles(tb, n, hashes))
                x, y = shingles(ta, n, hashes), last[1]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = materialise(map_batches(joined, compare, struct(("a", T.LongType()), ("b", T.LongType()))))
    discard(close, wanted, texts)
    return out


def link_classes(docs: DataFrame, sets: DataFrame, n: int, percent: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (sid, cid, n, more, prefix, parity, text_key, first_doc), and (node, root) for the cids that are linked."""
    classes = sets.filter(F.col("n") > 0).groupBy("sid").agg(
        F.min("doc_id").alias("first_doc"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "more", "prefix", "parity")]
    )
    # from here on a class is a number: half as long as its hash, and far easier to compress
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    postings = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    leaders = postings.groupBy("token").agg(F.min(F.struct("cid", "n", "pos")).alias("leader"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    live = materialise(postings.join(leaders.select("token", "leader"), "token"))

    def near(nx, px, ny, py) -> Column:
        """Sizes that can be linked, and a first common shingle early enough in both orders."""
        least = _least_overlap_col(nx, ny, percent)
        return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (px <= nx - least) & (py <= ny - least)

    def to_leader(rows: DataFrame) -> DataFrame:
        lead = F.col("leader")
        rows = rows.filter((F.col("cid") != lead["cid"]) & near(F.col("n"), F.col("pos"), lead["n"], lead["pos"]))
        return rows.select(F.col("cid").alias("a"), lead["cid"].alias("b")).distinct()

    links = _verified(to_leader(live), classes, docs, n, percent, text_col)
    roots = materialise(connected_components(links))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    def open_tokens(rows: DataFrame) -> DataFrame:
        """Postings of the shingles that still stand in more than one component."""
        split = rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1")
        return rows.join(split.select("token"), "token", "left_semi")

    # second round: another leader for each shingle, for those in other components than it
    still = materialise(open_tokens(rooted(live.drop("leader"))))
    discard(live)
    second = still.groupBy("token").agg(F.max(F.struct("cid", "n", "pos", "root")).alias("leader"))
    more = _verified(to_leader(still.join(second, "token").filter(F.col("root") != F.col("leader.root"))), classes, docs, n, percent, text_col)
    if not more.isEmpty():
        links = links.union(more)
        roots = materialise(connected_components(links))

    # the rest, pair by pair, unless the sketches already differ in more bits than linked sets in elements
    rest = materialise(open_tokens(rooted(still.drop("root"))).join(classes.select("cid", "parity"), "cid"))
    discard(still)
    x, y = rest.alias("x"), rest.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(1, PARITY // 64)), F.bit_count(F.get("x.parity", F.lit(0)).bitwiseXOR(F.get("y.parity", F.lit(0)))))
    pairs = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.cid") < F.col("y.cid"))
        & (F.col("x.root") != F.col("y.root"))
        & near(nx, F.col("x.pos"), ny, F.col("y.pos"))
        & (apart <= nx + ny - 2 * _least_overlap_col(nx, ny, percent)),
    )
    pairs = pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    more = _verified(pairs, classes, docs, n, percent, text_col)
    discard(rest)
    if not more.isEmpty():
        roots = materialise(connected_components(links.union(more)))
    return classes, roots


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of distinct n-word shingles (with fewer
    words, the whole sequence is one). component_id is the smallest doc_id reachable by links, itself included.
    Null, empty and blank texts have no shingles and link with nothing, not even each other. Repeated rows
    give a row each and are linked; rows with a null id count as documents, but a null is never the smallest id unless
    there is no other. Other columns are ignored. An empty table gives no rows.

    Equal sets are one class from the start; classes are named by a 128-bit hash of the set.
    """
    sets = materialise(_sets(docs, n, percent, id_col, text_col))
    classes, roots = link_classes(docs, sets, n, percent, text_col)
    named = classes.select("sid", "cid", "first_doc").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(least, "root").select("sid", "component_id")
    out = sets.select("doc_id", "n", "sid").join(named, "sid", "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
