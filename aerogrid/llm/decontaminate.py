"""Benchmark decontamination by winnowing.

Of the k-grams of a text, the smallest hash in each run of `span` neighbours is kept: its fingerprints. Any stretch of
k + span - 1 words that a document shares with an item therefore keeps a k-gram in both. The fingerprints of
documents and items are joined; where they meet, both sides lay out the windows around the place, and windows are joined
by their words. An item shorter than a window is one window, and its own k-gram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_words, discard, map_batches, materialise, raw_texts, small, struct

WINDOW, GRAM = 10, 5
#: Bits of the filter of the benchmark's fingerprints: 16 for each, within these bounds (8 MB are broadcast at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Words that a task keeps hashes of.
KEPT = 600_000

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    if len(hashes) > KEPT:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbouring words; grams of different k don't meet."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the (leftmost) smallest hash of some run of span neighbours."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= span:
        return np.array([int(hashes.argmin())])
    best = np.arange(n - span + 1)
    for j in range(1, span):
        best = np.where(hashes[j : n - span + 1 + j] < hashes[best], np.arange(j, n - span + 1 + j), best)
    return np.unique(best)


def fingerprints(words: list[bytes], hashes: WordHashes, sizes: Sequence[int], window: int, gram: int):
    """(size, places, hashes) for each window size: winnowed k-grams of full windows, all grams of shorter ones."""
    w = word_hashes(words, hashes)
    for size in sizes:
        if size == window:
            h = gram_hashes(w, gram)
            at = winnow(h, window - gram + 1) if len(w) >= window else np.zeros(0, np.int64)
            yield size, at, h[at]
        else:
            # seeded apart from the k-grams of full windows
            h = gram_hashes(w, size) ^ _STEP
            yield size, np.arange(len(h)), h


def windows_around(words: list[bytes], size: int, places: Sequence[int], window: int, gram: int) -> dict[int, bytes]:
    """start -> words of the windows of `size` that hold the fingerprint at one of the places."""
    reach = window - gram if size == window else 0
    last = len(words) - size
    starts = {s for p in places for s in range(max(0, p - reach), min(p, last) + 1)}
    return {s: b" ".join(words[s : s + size]) for s in starts}


def bits_of(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(n - 1)).astype(np.int64), (hashes >> np.uint64(36) & np.uint64(n - 1)).astype(np.int64)


def bit_filter(grams: DataFrame, rows: int, least: int = LEAST_BITS, most: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """A Bloom filter (64-bit words, number of bits) of a column `gram` of rows 64-bit hashes, made by a sum over all of them.

    It has 16 bits a hash while that is below `most`; with more hashes it lets more others through, which the joins then drop.
    """
    n = least
    while n < min(most, 16 * rows):
        n *= 2
    low, high = F.col("gram").bitwiseAND(F.lit(n - 1)), F.shiftrightunsigned("gram", 36).bitwiseAND(F.lit(n - 1))
    bits = grams.select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # n / 64 rows at most
    filled = np.zeros(n // 64, np.int64)
    filled[got["word"].to_numpy()] = got["mask"].to_numpy()
    return filled.view(np.uint64), n


def in_filter(hashes: np.ndarray, filled: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for bit in bits_of(hashes, n):
        out &= (filled[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _text_key(text) -> list:
    """Two 64-bit hashes that name a text; copies share them, and with them all that is found in the text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


PRINTS = struct(("size", T.IntegerType()), ("gram", T.LongType()), ("place", T.IntegerType()))
KEY = ["k1", "k2"]


def _printed(rows: DataFrame, carried: list[str], sizes: list[int], window: int, gram: int, keep) -> DataFrame:
    """carried columns, n_words and prints (size, gram, place) of each row; keep(hashes) thins the prints out."""
    kinds = [rows.schema[c] for c in carried]
    arrow = pa.list_(pa.struct([("size", pa.int32()), ("gram", pa.int64()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, ends, flat = [], [0], ([], [], [])
            for raw in raw_texts(batch):
                words, total = ascii_words(raw), 0
                counts.append(len(words))
                for size, at, h in fingerprints(words, hashes, sizes, window, gram):
                    kept = keep(h)
                    at, h = at[kept], h[kept]
                    if len(at):
                        for part, values in zip(flat, (np.full(len(at), size), h.view(np.int64), at), strict=True):
                            part.append(values)
                        total += len(at)
                ends.append(ends[-1] + total)
            one = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in flat]
            values = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip(one, arrow.value_type, strict=True)], fields=list(arrow.value_type))
            prints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carried], pa.array(counts, pa.int64()), prints], names=[*carried, "n_words", "prints"])

    return map_batches(rows, run, T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(PRINTS))]))


def _windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """k1, k2, size, start and words of the windows around the places in `found` (size, place) of each row.

    A task lays out copies of a text once.
    """
    names = [*KEY, "size", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "found")}
            keys = list(zip(of["k1"].to_pylist(), of["k2"].to_pylist(), strict=True))
            row, sizes, starts, texts = [], [], [], []
            for i, raw in enumerate(raw_texts(batch)):
                if keys[i] in seen:
                    continue
                seen.add(keys[i])
                places: dict[int, list[int]] = {}
                for f in of["found"][i].as_py():
                    places.setdefault(f["size"], []).append(f["place"])
                words = ascii_words(raw)
                for size, at in places.items():
                    laid = windows_around(words, size, at, window, gram)
                    row += [i] * len(laid)
                    sizes += [size] * len(laid)
                    starts += laid.keys()
                    texts += laid.values()
            if len(seen) > 1_000_000:
                seen.clear()
            for i in range(0, len(row), 20_000):
                cut = slice(i, i + 20_000)
                at = pa.array(row[cut], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [of["k1"].take(at), of["k2"].take(at), pa.array(sizes[cut], pa.int32()), pa.array(starts[cut], pa.int32()), pa.array(texts[cut], pa.binary())],
                    names=names,
                )

    out = [("k1", T.LongType()), ("k2", T.LongType()), ("size", T.IntegerType()), ("start", T.IntegerType()), ("words", T.BinaryType())]
    return map_batches(rows, run, struct(*out))


def _matched(printed: DataFrame, grams: DataFrame) -> DataFrame:
    """Keys and found (size, place): where the fingerprints of printed, a row for each text, are among grams (size, gram)."""
    each = printed.select(*KEY, F.explode("prints").alias("p")).select(*KEY, "p.size", "p.gram", "p.place")
    met = each.join(small(grams), ["size", "gram"], "left_semi")
    return met.groupBy(*KEY).agg(F.collect_list(F.struct("size", "place")).alias("found"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (start, end) of the windows hit.

    A window is `window` consecutive words of an item (a shorter item is one window, an empty one none); a document
    word inside any occurrence of a window is hit. Null texts have no words; items with a null id can hit
    but aren't counted; items that share an id count once. Repeated documents give a row each, null ids stay null,
    other columns are ignored. With an empty benchmark nothing is hit; no documents give no rows.

    Texts are read twice: for fingerprints, and (only those that met the benchmark) for windows. What is found
    belongs to a text, so copies of one are looked at once. The items of a window are rows, never one array; only
    n_items and items_sha256 need a list, which is made once for all texts that hit the same windows' sets of items. A filter of at most 8 MB of the benchmark's fingerprints thins out those
    of the documents before the join; tables are broadcast up to scratch.BROADCAST_BYTES and shuffled beyond.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), *_text_key(text), text.alias("text"))

    # the benchmark: fingerprints of its texts, and which window sizes there are
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", *_text_key(F.col("text")), "text").filter(F.col("text").isNotNull())
    texts = items.select(*KEY, "text").dropDuplicates(KEY)
    n_of = materialise(_printed(texts, [*KEY, "text"], [window], window, gram, lambda h: slice(None)))
    short = [r["n_words"] for r in n_of.filter((F.col("n_words") > 0) & (F.col("n_words") < window)).select("n_words").distinct().collect()]  # under `window` rows
    own = n_of.withColumn("size", F.least("n_words", F.lit(window)).cast("int"))
    item_prints = own.filter(F.col("n_words") >= window)
    if short:
        more = _printed(own.filter((F.col("n_words") > 0) & (F.col("n_words") < window)).select(*KEY, "size", "text"), [*KEY, "size", "text"], sorted(short), window, gram, lambda h: slice(None))
        more = more.withColumn("prints", F.filter("prints", lambda p: p["size"] == F.col("size")))
        item_prints = item_prints.unionByName(more)
    item_prints = materialise(item_prints.select(*KEY, "text", "prints"))
    grams = materialise(item_prints.select(F.explode("prints").alias("p")).select("p.size", "p.gram").distinct())
    filled = spark.sparkContext.broadcast(bit_filter(grams, grams.count()))
    sizes = sorted({*short, window})

    printed = materialise(_printed(rows, ["doc_id", *KEY], sizes, window, gram, lambda h: in_filter(h, *filled.value)))
    met = materialise(_matched(printed.filter(F.size("prints") > 0).dropDuplicates(KEY), grams))
    doc_windows = rows.select(*KEY, "text").join(small(met, F.size("found") * 8), KEY)
    doc_windows = materialise(_windows(doc_windows, window, gram).distinct())

    # the benchmark's windows, only around fingerprints that documents have too
    used = printed.select(F.explode("prints").alias("p")).select("p.size", "p.gram").distinct()
    used = materialise(used.join(small(grams), ["size", "gram"], "left_semi"))
    item_windows = _windows(item_prints.select(*KEY, "text").join(_matched(item_prints, used), KEY), window, gram)
    # a window's items stay rows; what names their set is a hash that needs no list of them
    own_key = ["size", "words"]
    holders = materialise(item_windows.select(*own_key, *KEY).distinct().join(items.select(*KEY, "item_id"), KEY).select(*own_key, "item_id").distinct())
    member = F.coalesce("item_id", F.lit(""))
    owned = holders.groupBy(*own_key).agg(
        F.xxhash64(F.bit_xor(F.xxhash64(member)), F.bit_xor(F.xxhash64(F.lit("item"), member)), F.count("item_id"), F.count(F.lit(1))).alias("owners")
    )
    owned = materialise(owned)

    near = small(owned, F.octet_length("words") + 8)
    hits = materialise(doc_windows.join(near, own_key).select(*KEY, "size", "start", "owners"))
    found = hits.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set("owners")).alias("sets"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    found = materialise(found.select(*KEY, "spans", covered.alias("n_hit"), "sets", F.xxhash64("sets").alias("mix")))

    # texts that hit the same sets of items share one list of names, which is made once
    mixes = found.groupBy("mix").agg(F.any_value("sets").alias("sets")).select("mix", F.explode("sets").alias("owners"))
    asked = hits.select("owners").distinct()
    one = owned.join(asked, "owners", "left_semi").groupBy("owners").agg(F.min(F.struct(*own_key)).alias("w")).select("owners", "w.*")
    members = materialise(holders.filter("item_id IS NOT NULL").join(one, own_key).select("owners", "item_id"))
    named = mixes.join(members, "owners").groupBy("mix").agg(F.sort_array(F.collect_set("item_id")).alias("names"))
    named = materialise(named.select("mix", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")))
    result = materialise(found.join(small(named, F.lit(80)), "mix", "left").select(*KEY, "spans", "n_hit", "n_items", "items_sha256"))
    discard(n_of, item_prints, grams, met, doc_windows, used, holders, owned, hits, found, members, named)

    out = printed.drop("prints").join(small(result, F.size("spans") * 8 + 80), KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
