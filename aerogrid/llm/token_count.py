"""Token counts with a whole-token shortcut.

Offline, the vocabulary is proven: which of its strings, standing alone as a pre-token, come out as one
token. (Being in the vocabulary isn't enough: the merges must lead there.) Counting then splits a text into
pre-tokens; each that is in the proven set counts one at once, and only the rest are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PieceCoder, coder
from .common import map_batches, materialise, raw_texts, struct, text_input

#: Merged pre-tokens that a worker keeps before it starts afresh; this bounds its memory, not its results.
KEPT = 600_000


def whole_tokens(code: PieceCoder) -> list[str]:
    """Vocabulary strings that encode alone as one token, as the library itself says."""
    back = {c: b for b, c in code.characters.items()}
    strings = []
    for shown in code.vocabulary:
        try:
            strings.append(bytes(back[c] for c in shown).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    out = code.library.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, out, strict=True) if len(e.ids) == 1 and code.pattern.fullmatch(s)]


class Costs(dict):
    """Tokens of a pre-token: proven whole tokens from the start, the rest merged when first met."""

    def __init__(self, code: PieceCoder, proven: list[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.code, self.proven = code, proven

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.code.ids(piece))
        return n

    def trim(self) -> None:
        if len(self) > KEPT + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give a row each; null ids stay null.
    Other columns of docs are ignored, whatever their names. An empty table gives no rows. Special
    strings inside a text are handled as the library does by default: it gets such texts whole. Files that normalise texts
    before they split them are refused, since a pre-token of the text as it stands then isn't one of the library's.
    One pass over the texts at once, no shuffle; the broadcast holds at most the vocabulary's strings.
    """
    if coder(tokenizer_path).normalises:
        raise ValueError(f"{tokenizer_path}: a file with a normaliser isn't supported")
    rows = text_input(docs, id_col, text_col)
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(whole_tokens(coder(tokenizer_path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        costs = Costs(code, proven.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for raw in raw_texts(batch):
                text = raw.decode("utf-8", "replace")
                n_bytes.append(len(raw))
                if code.plain(text):
                    n_tokens.append(sum(map(costs.__getitem__, code.pattern.findall(text))))
                    costs.trim()
                else:
                    n_tokens.append(len(code.whole(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["doc_id"].dataType
    out = struct(("doc_id", kind), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))
    return materialise(map_batches(rows, count, out))
