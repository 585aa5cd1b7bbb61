"""Language identification: script ranges narrow the candidates, Viterbi over words labels the spans.

A model is one table of log probabilities of hashed letter trigrams for each language, and the scripts that each is
written in. A word's score for a language is the sum over its trigrams, taken relative to the best language and cut off
below; changing language between words costs a fixed penalty, and the path of the best total labels every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialise, raw_texts, small_batches, struct, text_input

BUCKETS = 1 << 15
#: Documents of a language that a model is fitted on (about; they are chosen by a hash).
TRAIN_DOCS = 2000
PENALTY, FLOOR, WRONG_SCRIPT = 15.0, -6.0, -12.0
#: A language is written in a script if this share of its letters is.
SCRIPT_SHARE = 0.01

#: First code point and name of runs of letters; a run goes to the next entry.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane: whether it is a letter, and its script's number."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    script = np.zeros(0x10000, np.uint8)
    for (first, name), (after, _) in zip(SCRIPTS, (*SCRIPTS[1:], (0x10000, "")), strict=True):
        script[first:after] = SCRIPT_NAMES.index(name)
    return letter, script


class Words(NamedTuple):
    """The words of a text: trigram buckets, where each word's begin, letters and script of each word."""

    buckets: np.ndarray
    begins: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray


def split_words(raw: bytes) -> Words | None:
    """None without any letter. A character beyond the basic plane counts as Han if it is a letter."""
    text = raw.decode("utf-8", "replace").lower()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letter_of, script_of = _tables()
    if codes.size and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        codes = codes.copy()
        codes[high] = [0x4E00 if chr(c).isalpha() else 0x20 for c in codes[high].tolist()]
    letter = letter_of[codes]
    if not letter.any():
        return None
    # a blank before, after and between words
    padded = np.full(len(codes) + 2, 0x20, np.uint32)
    padded[1:-1] = np.where(letter, codes, 0x20)
    mixed = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(letter)
    first = np.concatenate([[True], np.diff(at) > 1])
    begins = np.flatnonzero(first)
    return Words(
        (mixed[at] >> np.uint32(17)).astype(np.int64),
        begins,
        np.diff(np.append(begins, len(at))),
        script_of[codes[at[begins]]],
    )


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # bucket x language, log probability
    allowed: np.ndarray  # script x language


def candidates(model: Model, words: Words) -> np.ndarray:
    """The languages that some word's script allows; all, if a word is of a script that no language is written in."""
    rows = model.allowed[np.flatnonzero(np.bincount(words.scripts))]
    return np.flatnonzero(rows.any(axis=0)) if rows.any(axis=1).all() else np.arange(len(model.languages))


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words x languages, at most 0; a word of a script that no language is written in says nothing."""
    allowed = model.allowed[words.scripts]
    open_ = candidates(model, words)
    if len(open_) < len(model.languages):
        sums = np.full(allowed.shape, -np.inf)
        sums[:, open_] = np.add.reduceat(model.table[words.buckets][:, open_], words.begins, axis=0)
    else:
        sums = np.add.reduceat(model.table[words.buckets], words.begins, axis=0)
    sums = np.where(allowed, sums, -np.inf)
    best = sums.max(axis=1, keepdims=True)
    known = np.isfinite(best)
    out = np.maximum(np.where(known, sums - np.where(known, best, 0), 0), FLOOR)
    return np.where(allowed | ~known, out, WRONG_SCRIPT)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path; ties go to the smaller number, and to staying."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # Any path that leaves the best single language gains on each of its spans at most the largest rise of the
    # summed difference; if no rise exceeds half a penalty, no path with a change is better than none.
    gains = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    lows = np.minimum.accumulate(np.vstack([np.zeros(gains.shape[1]), gains[:-1]]), axis=0)
    if (gains - lows).max() <= penalty / 2:
        return np.full(len(scores), best, np.int16)
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    stay, state = np.arange(k), scores[0].copy()
    for i in range(1, n):
        top = int(state.argmax())
        change = state[top] - penalty
        moved = change > state
        back[i] = np.where(moved, top, stay)
        state = np.where(moved, change, state) + scores[i]
    path = np.empty(n, np.int16)
    path[-1] = state.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label(model: Model, raw: bytes) -> tuple[str, float, list[tuple[str, int, int]]]:
    """(language, score, spans as (language, first word, word after)) of one text."""
    words = split_words(raw) if model.languages else None
    if words is None:
        return "und", 0.0, []
    scores = word_scores(model, words)
    path = viterbi(scores)
    weight = np.bincount(path, weights=words.letters, minlength=len(model.languages))
    total = scores.sum(axis=0)
    best = int(np.lexsort((-total, -weight))[0])
    sure = 1.0 / np.exp(np.minimum(total - total[best], 50)).sum()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
    spans = [(model.languages[path[a]], int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    share = weight[best] / weight.sum()
    return model.languages[best], float(min(1.0, share * (sure if len(spans) == 1 else 1.0))), spans


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = TRAIN_DOCS) -> Model:
    """A model of the languages in lang_col, from about max_docs documents of each, chosen by a hash.

    Rows without a language or text are left out. Executors count; the driver gets BUCKETS counts a language.
    """
    rows = training.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.element_at(
        F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, max_docs / sizes[lang])))]),
        F.col(lang_col).cast("string"),
    )
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {lang: np.zeros(BUCKETS, np.int64) for lang in languages}
        scripts = {lang: np.zeros(len(SCRIPT_NAMES), np.int64) for lang in languages}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                words = split_words(raw)
                if words is not None:
                    grams[lang] += np.bincount(words.buckets, minlength=BUCKETS)
                    scripts[lang] += np.bincount(words.scripts, weights=words.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang in languages:
            both = np.concatenate([grams[lang], scripts[lang]])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = map_batches(chosen, count, struct(("lang", T.StringType()), ("bucket", T.IntegerType()), ("n", T.LongType())))
    table = np.full((BUCKETS + len(SCRIPT_NAMES), len(languages)), 0.0)
    with small_batches(training.sparkSession):
        sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    numbers = {lang: i for i, lang in enumerate(languages)}
    table[sums["bucket"].to_numpy(), sums["lang"].map(numbers).to_numpy()] = sums["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS))
    allowed = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logs, allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1), spans (lang, first word, word after).

    lang_pred is the language of the most letters on the best path; `und` with score 0 for texts that are null, empty
    or without letters, or if the model knows no language. A tie goes to the larger total, then to the
    smaller name. Repeated rows give a row each, null ids stay null, other columns are ignored. An empty
    table gives no rows. One pass at once, no shuffle; the broadcast is BUCKETS numbers a language.
    """
    rows = text_input(docs, id_col, text_col)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(struct(("lang", T.StringType()), ("begin", T.LongType()), ("end", T.LongType())))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            found = [label(known, raw) for raw in raw_texts(batch)]
            spans = [[{"lang": lang, "begin": a, "end": b} for lang, a, b in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    out = struct(("doc_id", rows.schema["doc_id"].dataType), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", span))
    return materialise(map_batches(rows, run, out))
