"""Vocabulary files of the public tokenizers, read inside tasks, and tables for fast merging."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

# Fixed values of every byte-level vocabulary here: the printable byte that stands for each byte.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in vocabulary files: itself if printable, else from U+0100 on."""
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairTable:
    """From pairs of symbol ids to (rank, new id): an open-addressing hash table of numpy arrays."""

    ABSENT = np.int64(2**31 - 1)

    def __init__(self, left, right, rank, made) -> None:
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        size = 1 << self.bits
        self.keys = np.full(size, 2**64 - 1, np.uint64)
        self.rank = np.full(size, self.ABSENT, np.int64)
        self.made = np.zeros(size, np.int32)
        rank, made = np.asarray(rank, np.int64), np.asarray(made, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            # Of several keys that want one free place, the last written has it; the others move on.
            self.keys[at[todo[free]]] = keys[todo[free]]
            todo_done = self.keys[at[todo]] == keys[todo]
            won = todo[todo_done]
            self.rank[at[won]], self.made[at[won]] = rank[won], made[won]
            todo = todo[~todo_done]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 where it has none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(keys)
        got = self.keys[at]
        open_ = np.flatnonzero((got != keys) & (got != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got[open_] = self.keys[at[open_]]
            open_ = open_[(got[open_] != keys[open_]) & (got[open_] != np.uint64(2**64 - 1))]
        return np.where(got == keys, at, -1)


@lru_cache(maxsize=4)
def merge_list(path: str) -> tuple[np.ndarray, PairTable, list[str]]:
    """Symbol of each byte, merges by their place in the list, and the special strings, of a .json file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = spec["model"]["vocab"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    table = PairTable([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], range(len(pairs)),
                      [ids[a + b] for a, b in pairs])
    symbols = np.array([ids[letters[b]] for b in range(256)], np.int32)
    return symbols, table, [t["content"] for t in spec["added_tokens"] if t["special"]]


@lru_cache(maxsize=4)
def ranked_bytes(path: str) -> tuple[np.ndarray, PairTable, dict[bytes, int], list[bytes]]:
    """Symbol of each byte, merges by the rank of the joined bytes, ranks, and bytes by rank, of a .tiktoken file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    left, right, made = [], [], []
    for joined, rank in ranks.items():
        for cut in range(1, len(joined)):
            a, b = ranks.get(joined[:cut]), ranks.get(joined[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), made.append(rank)
    symbols = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    texts = [b""] * (max(ranks.values()) + 1)
    for joined, rank in ranks.items():
        texts[rank] = joined
    return symbols, PairTable(left, right, made, made), ranks, texts


@lru_cache(maxsize=1)
def piece_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Memory:
    """What is known of pieces already met; forgets all when it holds too many letters, so memory is bounded.

    ``of`` is a plain dictionary, which sets can be compared with without reading all of it.
    """

    def __init__(self, letters: int = 5_000_000) -> None:
        self.of: dict = {}
        self.letters = self.room = letters

    def learn(self, pieces, values) -> None:
        for piece, value in zip(pieces, values, strict=True):
            self.of[piece] = value
            self.room -= len(piece) + 20

    def tidy(self) -> None:
        if self.room < 0:
            self.of.clear()
            self.room = self.letters
