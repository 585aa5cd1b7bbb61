"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn, each time fitting a tree of at most four leaves on one feature's bins (then,
for chosen pairs, on two features' bins); the trees of a feature add up to one lookup table. A score is the
sum of one table entry a feature and pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialise, raw_texts, small_batches, struct, text_input

FEATURES = (
    "log_words", "word_length", "distinct_words", "upper", "digits", "marks", "symbols", "bars", "exclamations",
    "beyond_ascii", "log_lines", "distinct_lines", "compressed", "stops", "longest_word",
)
#: Labelled rows that a model is fitted on (about; they are chosen by a hash).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 8, 120, 60, 0.15


def _of(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


def features(raw: bytes) -> list[float]:
    """Numbers of one text; all are defined for the empty one."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    solid = max(1, n - int(counts[_of(" \n\t\r")].sum()))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lengths = max(1, len(words))
    return [
        float(np.log1p(len(words))),
        solid / lengths,
        len(set(words)) / lengths,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) / solid,
        int(counts[_of(".,;:?'\"()-")].sum()) / solid,
        int(counts[_of("#$%&*@^~=+<>{}[]\\/_`")].sum()) / solid,
        int(counts[_of("|")].sum()) / solid,
        int(counts[_of("!")].sum()) / solid,
        int(counts[128:].sum()) / solid,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / n,
        raw.count(b". ") / lengths,
        float(np.log1p(max(map(len, words), default=0))),
    ]


class Model(NamedTuple):
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[
                np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")
            ]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """The bin after which to cut, or 0 if no cut gains."""
    if len(g) < 2:
        return 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
    at = int(gain.argmax())
    return at + 1 if gain[at] > _gain(g.sum(), h.sum()) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One tree of two levels over the bins of a feature: a value for each bin."""
    middle = _split(g, h)
    cuts = [0, middle + (_split(g[middle:], h[middle:]) if middle else 0), middle, _split(g[:middle], h[:middle]), len(g)]
    cuts = sorted(set(cuts))
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut in each of two features: a value for each cell, and the gain."""
    best, out = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = g.shape
    for i in range(rows - 1):
        for j in range(cols - 1):
            quarters = [
                (cg[i, j], ch[i, j], np.s_[: i + 1, : j + 1]),
                (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j], np.s_[: i + 1, j + 1 :]),
                (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j], np.s_[i + 1 :, : j + 1]),
                (cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j], np.s_[i + 1 :, j + 1 :]),
            ]
            gain = sum(_gain(a, b) for a, b, _ in quarters)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for a, b, where in quarters:
                    out[where] = a / (b + 1.0)
    return out, best - _gain(g.sum(), h.sum())


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss; with no rows, or one label alone, a constant."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base, width = float(np.log(rate / (1 - rate))), len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return Model(base if len(y) else 0.0, [np.zeros(0)] * width, [np.zeros(1)] * width, [], [np.zeros(0)] * width, [])
    edges, coarse = [_edges(x[:, j], BINS) for j in range(width)], [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slope()
            m = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m))
            tables[j] += step
            total += step[bins[j]]

    def grid(a: int, b: int):
        g, h = slope()
        wide = len(coarse[b]) + 1
        shape, flat = (len(coarse[a]) + 1, wide), cells[a] * wide + cells[b]
        return np.bincount(flat, g, shape[0] * wide).reshape(shape), np.bincount(flat, h, shape[0] * wide).reshape(shape), flat

    gains = {(a, b): _pair_tree(*grid(a, b)[:2])[1] for a in range(width) for b in range(a + 1, width)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h, flat = grid(a, b)
            step = RATE * _pair_tree(g, h)[0]
            pair_tables[k] += step
            total += step.ravel()[flat]
    return Model(base, edges, tables, pairs, coarse, pair_tables)


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id, h, label and features of the rows of (doc_id, h, label, text)."""
    kinds = [docs.schema[c] for c in ("doc_id", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(raw) for raw in raw_texts(batch)]
            of = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "h", "label")]
            yield pa.RecordBatch.from_arrays([*of, pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "h", "label", "x"])

    return map_batches(docs, run, T.StructType([*kinds, *struct(("label", T.IntegerType()), ("x", T.ArrayType(T.DoubleType()))).fields]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> Model:
    """A model of 0/1 labels from about max_rows labelled documents, chosen by a hash of the id.

    Rows without a label or id are left out; an id that is labelled twice takes the larger label. Of an id that many rows
    share, one text is fitted on (that of the smallest hash). The labels chosen are few enough to broadcast, and their documents'
    features (a hundred bytes each) to fit on the driver.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(F.col(label_col)) > 0).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    with small_batches(docs.sparkSession):
        got = _featured(rows.withColumn("h", F.xxhash64("text"))).groupBy("doc_id").agg(F.min_by(F.struct("x", "label"), "h").alias("r")).select("r.*").collect()
    got.sort(key=lambda r: (r["x"], r["label"]))  # the same model however the rows arrive
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return train(x, np.array([r["label"] for r in got], float))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts are scored as empty ones. Repeated rows give a row each with the same score, null ids stay null,
    other columns are ignored; an empty table gives no rows. One pass at once, no shuffle.
    """
    rows = text_input(docs, id_col, text_col)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(raw) for raw in raw_texts(batch)], float).reshape(batch.num_rows, len(FEATURES))
            score = spread.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return materialise(map_batches(rows, run, struct(("doc_id", rows.schema["doc_id"].dataType), ("score", T.DoubleType()), ("predicted", T.IntegerType()))))
