"""Byte-level BPE of whole texts: ids, and the bytes that each id stands for.

A vocabulary whose numbers are its merge order is also a rank table; texts then go through
tiktoken, which gives the same ids several times faster than the tokenizers library.  What
tiktoken refuses (its pattern runs out of stack on megabytes of white space) and vocabularies
in another order go through tokenizers itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each char of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encodes with a byte-level tokenizer file, its truncation and padding unused.

    With `plain`, strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        chars = _bytes_of_chars()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.entries = {i: bytes(map(chars.__getitem__, t)) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ordered = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and all(vocab.get(t) == i for i, t in enumerate(merges, len(vocab) - len(merges))) and len(vocab) - len(merges) == 256
        plain_specials = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.entries[i]: i for i in vocab.values()}, special_tokens=added) if ordered and plain_specials else None
        self.allowed = set() if plain else set(added)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text as unsigned 32-bit numbers."""
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
            except ValueError:
                pass  # its pattern ran out of stack: long white space
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def byte_lengths(self) -> np.ndarray:
        """Number of bytes of each id's entry."""
        out = np.zeros(max(self.entries) + 1, np.int64)
        for i, entry in self.entries.items():
            out[i] = len(entry)
        return out


@lru_cache(4)
def byte_bpe(path: str, plain: bool = False) -> ByteBpe:
    """One table a worker."""
    return ByteBpe(path, plain)
