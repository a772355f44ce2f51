"""Byte-level BPE vocabularies: ranks, pre-tokens and token bytes, read from a public tokenizer file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: A blank beside other white space.
_DOUBLE = re.compile(r"\s | \s")
#: Rank of a pair that does not merge.
NONE = np.int64(1 << 30)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself,
    the other bytes take code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE: ``pairs`` (sorted keys left << 32 | right), their ``ranks`` and merged ``ids``."""

    #: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        symbols = _byte_symbols()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.of_byte[b] = ids[c]
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            keys.append(ids[a] << 32 | ids[b]), ranks.append(rank), made.append(ids[a + b])
        order = np.argsort(np.asarray(keys, np.int64), kind="stable")
        self.pairs = np.asarray(keys, np.int64)[order]
        self.ranks = np.asarray(ranks, np.int64)[order]
        self.made = np.asarray(made, np.int32)[order]
        # an open-addressed table over the pairs: a lookup costs a few gathers instead of a binary search
        self.bits = int(np.ceil(np.log2(4 * len(keys))))
        slots = np.full(1 << self.bits, -1, np.int32)
        todo, probe = np.arange(len(keys)), 0
        place = self._slot(self.pairs)
        while len(todo):
            at = (place[todo] + probe) & ((1 << self.bits) - 1)
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            todo = todo[slots[at] != todo]
            probe += 1
        self.slots, self.probes = slots, probe
        self.split = regex.compile(self.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``pairs``, or -1. Negative ids pair with nothing."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        place = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for probe in range(self.probes):
            if not len(open_):
                break
            got = self.slots[(place[open_] + probe) & ((1 << self.bits) - 1)]
            hit = (got >= 0) & (self.pairs[got] == keys[open_])
            out[open_[hit]] = got[hit]
            open_ = open_[(got >= 0) & ~hit]
        return out

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; the strings of added tokens come out whole, as the library's default has it.

        No pre-token holds a blank but as its first character, so a text without white space beside a blank
        falls apart before its blanks, and a part of letters alone is one pre-token without matching."""
        if self.cut is not None and any(a in text for a in self.added):
            out: list[str] = []
            for i, piece in enumerate(self.cut(text)):
                out += [piece] if i % 2 else self.pretokens(piece)
            return out
        if not text or _DOUBLE.search(text) or text[0] == " " or text[-1] == " ":
            return self.split(text)
        first, *rest = text.split(" ")
        out = self.split(first)
        for word in rest:
            if word.isalpha():
                out.append(" " + word)
            else:
                out += self.split(" " + word)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per process and path."""
    return Vocabulary(path)
