"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts only those are kept that begin at a minimiser: the k-gram of words with the smallest hash
among the k-grams of some window of min_words words. Equal windows choose equal minimisers, so a passage of that
length which two documents share has a kept suffix in both, with as many words before it in either. Suffixes whose first
k-gram occurs in one document alone are put aside; the others are sorted, neighbours compared to the right, and the
matches extended to the left. Where very many suffixes have one first k-gram, their windows are counted by hash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, discard, map_batches, materialise, raw_texts, small, struct, text_input

MIN_WORDS, GRAM = 50, 8
#: Suffixes of one k-gram, with different words around it, beyond which their windows are counted instead of sorted (8 MB of words).
HOT = 20_000
#: Bits of the filter of repeated k-grams: 16 for each, within these bounds (at most 32 MB are broadcast). Beyond, a join drops the rest.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordCodes(dict):
    """32-bit codes of words; 0 stands for no word."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh32_intdigest(word) or 1
        return h


def word_codes(raw: bytes, codes: WordCodes) -> np.ndarray:
    words = blank_words(raw)
    if len(codes) > 600_000:
        codes.clear()
    return np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w.astype(np.uint64)) * _A
    h ^= h >> np.uint64(31)
    return h * _B


def minimisers(codes: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the leftmost smallest k-gram hash of each window of min_words words, and the hashes there."""
    n = len(codes)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        h = _mix(h, codes[j : j + len(h)])
    h ^= h >> np.uint64(29)

    def smaller(at: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.where(h[other] < h[at], other, at)

    best, width, want = np.arange(len(h)), 1, min_words - gram + 1
    while width * 2 <= want:
        best = smaller(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = smaller(best[: len(h) - want + 1], best[want - width :])
    at = np.unique(best)
    return at, h[at]


def bloom_bits(hashes, n: int):
    """Two bit numbers below n (a power of two) for each 64-bit hash; as columns or as arrays."""
    if isinstance(hashes, np.ndarray):
        return (hashes & np.uint64(n - 1)).astype(np.int64), (hashes >> np.uint64(36) & np.uint64(n - 1)).astype(np.int64)
    return hashes.bitwiseAND(F.lit(n - 1)), F.shiftrightunsigned(hashes, 36).bitwiseAND(F.lit(n - 1))


def repeated_grams(docs: DataFrame, min_words: int, gram: int) -> tuple[DataFrame, np.ndarray, int]:
    """The minimiser k-grams that two or more documents hold, and a Bloom filter of them (64-bit words, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            held = [np.unique(minimisers(word_codes(raw, codes), min_words, gram)[1]) for raw in raw_texts(batch)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["gram"])

    grams = map_batches(docs.select("text"), run, struct(("gram", T.LongType())))
    repeated = materialise(grams.groupBy("gram").count().filter("count > 1").select("gram"))
    n, wanted = LEAST_BITS, 16 * repeated.count()
    while n < min(MOST_BITS, wanted):
        n *= 2
    bits = repeated.select(F.explode(F.array(*bloom_bits(F.col("gram"), n))).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # n / 64 rows at most
    filled = np.zeros(n // 64, np.int64)
    filled[got["word"].to_numpy()] = got["mask"].to_numpy()
    return repeated, filled.view(np.uint64), n


def _in_filter(hashes: np.ndarray, filled: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for bit in bloom_bits(hashes, n):
        out &= (filled[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


_SUFFIX = struct(
    ("gram", T.LongType()),
    ("low", T.IntegerType()),
    ("high", T.IntegerType()),
    ("right", T.BinaryType()),
    ("left", T.BinaryType()),
    ("places", T.ArrayType(T.IntegerType())),
)
_SUFFIX_ARROW = pa.list_(
    pa.struct(
        [("gram", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("places", pa.list_(pa.int32()))]
    )
)


def _suffixes(docs: DataFrame, min_words: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Per row: row_id, doc_id, n_words, and the kept suffixes with the words around them; and these suffixes as rows."""
    repeated, filled_, bits_ = repeated_grams(docs, min_words, gram)
    spread = docs.sparkSession.sparkContext.broadcast((filled_, bits_))
    reach = min_words - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (filled, bits) = WordCodes(), spread.value
        for batch in batches:
            sizes, kept = [], []
            for raw in raw_texts(batch):
                c = word_codes(raw, codes)
                at, hashes = minimisers(c, min_words, gram)
                open_ = _in_filter(hashes, filled, bits)
                at, hashes = at[open_], hashes[open_].view(np.int64)
                sizes.append(len(c))
                if not len(at):
                    kept.append([])
                    continue
                padded = np.concatenate([np.zeros(reach, np.uint32), c, np.zeros(min_words, np.uint32)])
                right = padded[at[:, None] + (reach + np.arange(min_words))]
                left = padded[at[:, None] + (reach - 1 - np.arange(reach))]
                low, high = np.maximum(0, at + min_words - len(c)), np.minimum(reach, at)
                own: dict[tuple, list] = {}
                for i in range(len(at)):
                    own.setdefault((int(hashes[i]), int(low[i]), int(high[i]), right[i].tobytes(), left[i].tobytes()), []).append(int(at[i]))
                kept.append([dict(zip(_SUFFIX.names, (*key, places), strict=True)) for key, places in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, _SUFFIX_ARROW)], names=["doc_id", "n_words", "suffixes"])

    out = struct(("doc_id", docs.schema["doc_id"].dataType), ("n_words", T.LongType()), ("suffixes", T.ArrayType(_SUFFIX)))
    rows = materialise(map_batches(docs, run, out).withColumn("row_id", F.monotonically_increasing_id()))
    each = rows.select("row_id", F.explode("suffixes").alias("s")).select("row_id", "s.*")
    if bits_ < 8 * repeated.count():  # the filter is too full to keep out most of the others
        each = each.join(repeated, "gram", "left_semi")
    return rows, each.withColumn("context", F.xxhash64("low", "high", "right", "left"))


def shared_windows(pdf: pd.DataFrame, min_words: int, gram: int) -> np.ndarray:
    """For rows sorted by (part, right): a bit for each j whose window, begun j words to the left, is in two documents.

    A window is equal in two rows if they agree in min_words - j words to the right, which makes them neighbours in this
    order, and in j words to the left.
    """
    reach, n = min_words - gram, len(pdf)
    part = pdf["part"].to_numpy()
    right = np.frombuffer(b"".join(pdf["right"]), np.uint32).reshape(n, min_words)
    left = np.frombuffer(b"".join(pdf["left"]), np.uint32).reshape(n, reach)
    low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
    u0, u1 = pdf["u0"].to_numpy(), pdf["u1"].to_numpy()
    same = right[1:] == right[:-1]
    common = np.where(same.all(axis=1), min_words, same.argmin(axis=1)) * (part[1:] == part[:-1])
    bits, leftwards = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for j in range(reach + 1):
        if j:
            leftwards = _mix(leftwards + np.uint64(1), left[:, j - 1])
        run = np.concatenate([[0], np.cumsum(common < min_words - j)])
        valid = np.flatnonzero((low <= j) & (j <= high))
        if not len(valid):
            continue
        order = valid[np.lexsort((leftwards[valid], run[valid]))]
        r, v = run[order], leftwards[order]
        edge = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
        apart = np.minimum.reduceat(u0[order], edge) != np.maximum.reduceat(u1[order], edge)
        hit = order[np.repeat(apart, np.diff(np.append(edge, len(order))))]
        bits[hit] |= np.int64(1) << np.int64(j)
    return bits


def counted_windows(contexts: DataFrame, min_words: int, hot: int) -> DataFrame:
    """gram, context and bits as of shared_windows, for contexts of any number: each window is a row, and equal ones are counted.

    Windows are compared within their k-gram and offset by 64-bit hashes. A window that more than `hot` contexts hold is looked
    up in a broadcast while those fit one, so that no task gets all its holders; beyond, the join's skewed partitions are split.
    """
    key = ["gram", "j", "window"]
    each = contexts.withColumn("j", F.explode(F.sequence("low", "high")))
    window = F.xxhash64(F.expr(f"substring(right, 1, 4 * ({min_words} - j))"), F.expr("substring(left, 1, 4 * j)"))
    windows = each.select("context", "u0", "u1", "gram", "j", window.alias("window"))
    held = windows.groupBy(*key).agg(F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.count(F.lit(1)).alias("n"))
    held = materialise(held.filter("u0 <> u1").select(*key, "n"))
    windows, by_many = windows.select("context", *key), small(held.filter(F.col("n") > hot).select(*key))
    hits = windows.join(by_many, key, "left_semi")
    hits = hits.unionByName(windows.join(by_many, key, "left_anti").join(held.filter(F.col("n") <= hot).select(*key), key, "left_semi"))
    return hits.groupBy("gram", "context").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits"))


def find_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_words, n_repeated, spans (begin, end: first word and word after).

    Words are runs without ASCII white space, A-Z lower-cased. A word is repeated if it lies in min_words
    consecutive words that occur in another row too; spans are the longest runs of repeated words. Repeats within one
    row alone don't count. Null, empty and shorter texts have no spans; repeated rows are repeats of each other; null ids
    stay null; other columns are ignored. An empty table gives no rows.

    Words are compared by 32-bit codes, min_words of them at a time; suffixes are named by two 64-bit hashes. hot: suffixes of a
    k-gram beyond which their windows are counted by hash, so that no task sorts more of one k-gram however large the table is.
    """
    if not 8 <= min_words - gram < 63:
        raise ValueError("min_words - gram must be from 8 to 62")
    reach = min_words - gram
    rows, each = _suffixes(text_input(docs, id_col, text_col), min_words, gram)
    contexts = each.groupBy("gram", "context").agg(
        F.min("row_id").alias("u0"), F.max("row_id").alias("u1"), *[F.first(c).alias(c) for c in ("low", "high", "right", "left")]
    )
    contexts = materialise(contexts)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = materialise(contexts.groupBy("gram").count().filter(F.col("count") > hot).select("gram"))  # at most contexts / hot
    few = contexts.join(small(crowded), "gram", "left_anti").withColumnRenamed("gram", "part")
    dealt = few.select("part", "context", "u0", "u1", "low", "high", "right", "left")
    sorted_ = dealt.repartition(F.col("part")).sortWithinPartitions("part", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(pdf: pd.DataFrame) -> pa.RecordBatch:
            bits = shared_windows(pdf, min_words, gram)
            some = bits != 0
            return pa.RecordBatch.from_arrays([pa.array(pdf["part"].to_numpy()[some]), pa.array(pdf["context"].to_numpy()[some]), pa.array(bits[some])], names=["gram", "context", "bits"])

        waiting, last = [], None
        for batch in batches:
            pdf = batch.to_pandas()
            part = pdf["part"].to_numpy()
            if not len(part):
                continue
            if part[-1] == last:  # rows are sorted: all of the batch goes on with the part that waits
                waiting.append(pdf)
                continue
            # whole parts end before the batch's last one begins
            begin = int(np.searchsorted(part, part[-1]))
            whole = [*waiting, pdf.iloc[:begin]]
            if sum(map(len, whole)):
                yield found(pd.concat(whole, ignore_index=True))
            waiting, last = [pdf.iloc[begin:]], part[-1]
        if waiting:
            yield found(pd.concat(waiting, ignore_index=True))

    shared = map_batches(sorted_, compare, struct(("gram", T.LongType()), ("context", T.LongType()), ("bits", T.LongType())))
    if not crowded.isEmpty():
        shared = shared.unionByName(counted_windows(contexts.join(small(crowded), "gram", "left_semi"), min_words, hot))
    shared = materialise(shared)
    discard(contexts, crowded)
    hits = each.select("row_id", "gram", "context", "places").join(small(shared), ["gram", "context"])
    # dealt out evenly: laying out spans takes Python far longer than the few bytes of a partition suggest
    even = max(parts, -(-rows.count() // 10_000))
    hits = hits.select("row_id", "places", "bits").repartition(even, "row_id").groupBy("row_id").agg(F.collect_list(F.struct("places", "bits")).alias("hits"))
    joined = rows.select("row_id", "doc_id", "n_words").repartition(even, "row_id").join(hits, "row_id", "left").select("doc_id", "n_words", "hits")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for size, got in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edge = np.zeros(size + 2, np.int32)
                for h in got or ():
                    back = np.flatnonzero([h["bits"] >> j & 1 for j in range(reach + 1)])
                    begin = (np.array(h["places"])[:, None] - back).ravel()
                    np.add.at(edge, begin + 1, 1)
                    np.add.at(edge, begin + 1 + min_words, -1) if size >= min_words else None
                inside = np.concatenate([[0], (np.cumsum(edge)[1:] > 0).astype(np.int8)]) if got else np.zeros(1, np.int8)
                turns = np.flatnonzero(np.diff(inside)) if got else []
                pairs = [{"begin": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                out.append(pairs)
                counts.append(sum(p["end"] - p["begin"] for p in pairs))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_words", "n_repeated", "spans"])

    span = T.ArrayType(struct(("begin", T.LongType()), ("end", T.LongType())))
    kind = rows.schema["doc_id"].dataType
    return map_batches(joined, spans, struct(("doc_id", kind), ("n_words", T.LongType()), ("n_repeated", T.LongType()), ("spans", span)))
