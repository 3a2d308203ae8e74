"""Ids of a byte-level BPE vocabulary for texts of any length and content."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import public_tokenizers

#: White space as the split pattern has it (the Unicode property), in runs that the pattern's engine cannot hold on its stack.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def plain_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The ids of a text in which nothing is a special token.

    The split pattern takes a run of white space up to its last character, which goes with the word behind it, and the
    whole run at the text's end.  Long runs are cut exactly there and merged as the one piece they are.
    """
    import tiktoken

    bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += bpe.encode_ordinary(text[at:run.start()])
            ids += bpe._encode_single_piece(text[run.start():end])
            at = end
        return ids + bpe.encode_ordinary(text[at:]) if at else bpe.encode_ordinary(text)

    return encode
