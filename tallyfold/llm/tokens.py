"""Token ids of whole texts by a public byte-level BPE vocabulary, with a memo of pieces."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Pieces that the memo holds before it starts anew, and the longest piece it takes.
MOST_PIECES, LONGEST = 300_000, 48
_SPACES = re.compile(r" \s|\s ")


def vocabulary() -> tuple[str, str]:
    """Paths of the default vocabulary: the tokenizer's file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers.

    A space between two other characters always starts a new piece of this vocabulary, so a text is
    split there and each piece is encoded once. Texts with runs of white space are encoded as a whole. ``plain``
    takes the strings of special tokens as ordinary text; otherwise the tokenizer itself encodes texts that may
    hold one.
    """

    def __init__(self, tokenizer: str, ranks: str, plain: bool = False) -> None:
        import public_tokenizers
        import tiktoken

        lines = map(bytes.split, Path(ranks).read_bytes().splitlines())
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
        self.ordinary, self.tokenizer, self.plain, self.special = own.encode_ordinary, tokenizer, plain, None
        self.memo = _Memo(self.ordinary)

    def encode(self, text: str) -> bytes:
        if "<|" in text and not self.plain:
            return _packed(self._with_special(text))
        if _SPACES.search(text):
            return _packed(self.ordinary(text))
        first, *rest = text.split(" ")
        memo = self.memo
        return b"".join([_packed(self.ordinary(first)), *[memo[p] for p in rest]])

    def _with_special(self, text: str) -> list[int]:
        if self.special is None:
            from tokenizers import Tokenizer

            self.special = Tokenizer.from_file(self.tokenizer)
        return self.special.encode(text, add_special_tokens=False).ids


class _Memo(dict):
    def __init__(self, encode) -> None:
        self.encode_piece = encode

    def __missing__(self, piece: str) -> bytes:
        ids = _packed(self.encode_piece(f" {piece}"))
        if len(piece) <= LONGEST:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str, plain: bool = False) -> Encoder:
    """One encoder for each Python worker, which the tasks that it runs share."""
    return Encoder(tokenizer, ranks, plain)
