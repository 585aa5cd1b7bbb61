"""Byte-level BPE files of the tokenizers library, read once a worker and asked word by word.

BPE never merges across pre-tokens, so a pre-token's ids depend on its own bytes alone and may be
kept. The files used here name their pre-token pattern; texts for which a kept answer could differ
from the library's (special strings, characters that are newer than Unicode 3.2 and that two
regular-expression libraries class differently) are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The pre-token pattern of byte-level BPE files that say use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest moves up to 256 and on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(1)
def unsettled() -> re.Pattern:
    """A character outside the basic plane or not assigned in Unicode 3.2."""
    known = [unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs") for c in range(0x10000)]
    runs, start = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and known[c]
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            runs.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return re.compile(f"[^{''.join(runs)}]")


class PieceCoder:
    """Ids of single pre-tokens by the file's own model, and of whole texts by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.specials = [t["content"] for t in said["added_tokens"]]
        steps = said["pre_tokenizer"]
        steps = steps.get("pretokenizers", [steps])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        level = [s for s in steps if s["type"] == "ByteLevel"]
        if said["model"]["type"] != "BPE" or len(level) != 1 or level[0]["add_prefix_space"] or len(own) > 1:
            raise ValueError(f"{path}: only byte-level BPE without a prefix space is supported")
        self.pattern = regex.compile(own[0] if own else BYTE_LEVEL_PATTERN)
        self.drops_space = bool(own)
        self.normalises = said["normalizer"] is not None
        self.lowers = "Lowercase" in json.dumps(said["normalizer"])
        self.characters = byte_characters()
        self.vocabulary = said["model"]["vocab"]

    def ids(self, piece: str) -> list[int]:
        shown = piece.encode("utf-8").decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(shown)]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        """Whether kept answers hold for this text."""
        return not any(s in text for s in self.specials) and (text.isascii() or not unsettled().search(text))


@lru_cache(4)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)
