"""Exact ids of a byte-level BPE vocabulary in little time.

The ids are those of the tokenizers library for the .json file. The merges run in a rank-based
encoder built from the very same file; a text is first cut at the special strings, which the
library turns into their own ids wherever they stand. tests/llm hold both libraries against each other
over every code point and over random texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

#: The bytes that the vocabulary file shows as themselves; the others are shown from code point 256 on (fixed values).
SHOWN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]


def vocabulary_path(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts; specials are cut out first, as the library does by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        letters = byte_letters()
        self.ranks = {bytes(letters[c] for c in token): i for token, i in loaded["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in loaded["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at odd places."""
        return self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]

    def ids(self, text: str) -> np.ndarray:
        parts = self.parts(text)
        if len(parts) == 1:
            return np.asarray(self.coder.encode_to_numpy(text, disallowed_special=()), np.uint32)
        done = [np.asarray([self.special[x]] if i % 2 else self.coder.encode_to_numpy(x, disallowed_special=()), np.uint32) for i, x in enumerate(parts)]
        return np.concatenate(done)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(vocabulary_path(name))
