"""Token ids of whole texts under a public byte-level BPE.

Two libraries hold the same vocabulary: one reads the tokenizer file, the other, some
four times as fast, its ranks. The first decides wherever they could differ: texts with
a special token's string, and scripts beyond Latin, whose letters the two may class by
different editions of Unicode.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

# A special token, or a character that is neither Latin nor usual punctuation or currency.
_FIRST_DECIDES = re.compile(r"<\|endoftext\|>|[^\x00-ɏ‐-‧‰-⁞₠-₿]")


class ByteBpe:
    def __init__(self, tokenizer_file: str, ranks_file: str):
        self.tokenizer_file = tokenizer_file
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.second = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def first(self) -> Tokenizer:
        """Read when a text needs it."""
        return Tokenizer.from_file(self.tokenizer_file)

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizer file gives them without added special tokens (uint16)."""
        if _FIRST_DECIDES.search(text):
            return np.array(self.first.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.array(self.second.encode_ordinary(text), np.uint16)


_ready: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(tokenizer_file: str, ranks_file: str) -> ByteBpe:
    """The encoder of this worker, read once."""
    key = tokenizer_file, ranks_file
    if key not in _ready:
        _ready[key] = ByteBpe(*key)
    return _ready[key]


def default_files() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
