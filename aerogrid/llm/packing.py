"""Packing of tokenised documents into fixed windows by minimum bin slack.

Documents are cut into full windows and one remainder. Remainders are dealt into groups of bounded size, and each
group fills window after window: a subset-sum over the lengths still there, held as a bit set in one integer,
finds the reachable total closest to the capacity; walking back through the stages of that sum says how many pieces
of each length to take.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PieceCoder, coder
from .common import map_batches, materialise, raw_texts, struct, text_input

#: Words and pre-tokens whose ids a worker keeps before it starts afresh; this bounds its memory, not its results.
KEPT, KEPT_PIECES = 400_000, 150_000
#: Control characters at which Python splits words and tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")

PIECES = struct(
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
)


class WordIds(dict):
    """The ids of a blank-separated, normalised word as little-endian bytes; words never share a pre-token."""

    def __init__(self, code: PieceCoder):
        super().__init__()
        self.code, self.pieces = code, {}

    def __missing__(self, word: str) -> bytes:
        out = []
        for piece in self.code.pattern.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = np.array(self.code.ids(piece), "<u4").tobytes()
            out.append(ids)
        self[word] = got = b"".join(out)
        return got

    def trim(self) -> None:
        if len(self) > KEPT:
            self.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()


def text_ids(code: PieceCoder, words: WordIds, raw: bytes) -> bytes:
    """The ids of a text as the library gives them, four bytes each."""
    text = raw.decode("utf-8", "replace")
    if not code.plain(text) or SEPARATORS.search(text):
        return np.array(code.whole(text), "<u4").tobytes()
    if code.lowers:
        # below U+0130 normal form C and contextual lower-casing change nothing else
        text = text.lower() if text.isascii() or max(text) < "İ" else code.library.normalizer.normalize_str(text)
    got = b"".join(map(words.__getitem__, text.split()))
    words.trim()
    return got


def fill_window(counts: list[int], lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a selection with the least slack; counts is indexed by length, lengths falls.

    The longest piece left is always taken, so that no long piece waits for ever.
    """
    first = next(n for n in lengths if counts[n])
    room, want = capacity - first, 1 << (capacity - first)
    mask, reach, stages = (want << 1) - 1, 1, []
    for n in lengths:
        have = counts[n] - (n == first)
        if have <= 0 or n > room:
            continue
        before, have, step = reach, min(have, room // n), 1
        left = have
        while left:  # so many copies of n at most, by doubling
            step = min(step, left)
            reach |= (reach << (n * step)) & mask
            left -= step
            step *= 2
        stages.append((n, have, before))
        if reach & want:
            break
    total, taken = reach.bit_length() - 1, {first: 1}
    for n, have, before in reversed(stages):
        used = 0
        while not before >> total & 1:
            total, used = total - n, used + 1
        if used:
            taken[n] = taken.get(n, 0) + used
    return list(taken.items())


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; pieces of one length are taken in their order here."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    counts = [0] * (capacity + 1)
    for n, those in waiting.items():
        counts[n] = len(those)
    present, left, at = sorted(waiting, reverse=True), len(lengths), 0
    while left:
        place = 0
        for n, used in fill_window(counts, present, capacity):
            for _ in range(used):
                i = waiting[n].pop()
                window[i], offset[i] = at, place
                place += n
            counts[n] -= used
            left -= used
        if not left % 64:
            present = [n for n in present if counts[n]]
        at += 1
    return window, offset


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    group_rows: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the library's for its text, then end_id; null and empty texts have end_id alone.
    A document of n ids is cut at multiples of capacity; its full pieces are sequences of their own. Rows are
    dealt in turn over groups of about group_rows documents, each packed by one task with no others; only
    the last windows of a group keep some slack. Repeated rows, null ids and ties (equal lengths, taken in the
    order of the group) are rows like others. Other columns are ignored. An empty table gives no rows.
    The texts are read once; only a row of a few numbers for each document is shuffled.
    """
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    groups = max(1, -(-docs.count() // group_rows))
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        words = WordIds(code)
        part = TaskContext.get().partitionId()
        turn = part * 7919
        for batch in batches:
            tokens, sums = [], []
            for raw in raw_texts(batch):
                ids = text_ids(code, words, raw) + tail
                tokens.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
            order = np.arange(turn, turn + len(tokens), dtype=np.int64)
            turn += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(order % groups, pa.int64()),
                    pa.array(order, pa.int64()),
                    pa.array([part] * len(tokens), pa.int32()),
                    batch.column(0),
                    pa.array(tokens, pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())),
                ],
                names=["pack_group", "turn", "part", "doc_id", "doc_tokens", "sums"],
            )

    encoded = materialise(
        map_batches(
            rows,
            encode,
            struct(
                ("pack_group", T.LongType()),
                ("turn", T.LongType()),
                ("part", T.IntegerType()),
                ("doc_id", kind),
                ("doc_tokens", T.LongType()),
                ("sums", T.ArrayType(T.LongType())),
            ),
        )
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "turn"], ignore_index=True)
        tokens = pdf["doc_tokens"].to_numpy()
        pieces = -(-tokens // capacity)
        row = np.repeat(np.arange(len(pdf)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(tokens[row] - start, capacity)
        window, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        full = length == capacity
        window[full] = np.arange(full.sum())
        if not full.all():
            window[~full], offset[~full] = pack_lengths(length[~full], capacity)
            window[~full] += full.sum()
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"].take(row).to_numpy(),
                "start": start,
                "length": length,
                "ids_crc32": np.concatenate([np.asarray(s, np.int64) for s in pdf["sums"]]),
                "doc_tokens": tokens[row],
                "sequence_id": (int(pdf["pack_group"].iat[0]) << 32) + window,
                "offset": offset,
            }
        )

    out = T.StructType([T.StructField("doc_id", kind), *PIECES.fields])
    return encoded.groupBy("pack_group").applyInPandas(fill, out).select(F.col("doc_id"), *[f.name for f in PIECES])
