"""Token ids of whole texts, as a vocabulary file of the tokenizers library gives them."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

KEEP = 250_000  # pieces that a worker remembers; beyond that, pieces are worked out anew each time


@functools.cache
def tokenizer(path: str):
    # Spark runs a task per core already
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def forget(known: dict, new: dict) -> None:
    """Bring what is known down to ``KEEP`` pieces again, the newest first."""
    over = len(known) - KEEP
    if over > 0:
        for piece in list(new)[:over]:
            del known[piece]


# Fixed value: how a byte-level vocabulary of this kind splits texts before any merge
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Texts of Latin letters, ASCII signs and short words, on whose splitting all libraries agree.
_COMMON = re.compile(r"[ \t\n\r]{0,20}+(?:[!-~À-ÖØ-öø-ň]{1,400}+(?:[ \t\n\r]{1,20}+|\Z))*+")


def _byte_of() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(path: str):
    """The vocabulary as byte strings with their ranks, if its ids are in the order of its merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, byte_of = model["vocab"], _byte_of()
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(vocabulary) != 256 + len(merged):
        return None
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items()}
    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Ids of a byte-level vocabulary as little-endian unsigned 16- or 32-bit integers.

    Common texts are encoded by tiktoken with the ranks that the file's merges give, which is several times as fast and
    gives the same ids; all other texts, and those that may hold a special token, by the tokenizers library.
    """

    def __init__(self, path: str):
        self.library, self.ranked = tokenizer(path), _ranked(path)
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def _one(self, text: str) -> bytes:
        if self.ranked is not None and "<|" not in text and _COMMON.fullmatch(text):
            return np.array(self.ranked.encode_ordinary(text), self.width).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null reads as empty."""
        return [self._one(text or "") for text in texts]


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
