"""Token counts by merging in the order of ranks, all sequences of a batch at once.

Pre-tokens not met before are held as one ragged numpy array of symbols (``ragged``): in
a round each sequence merges its lowest-ranked pair everywhere at the same time, and a
sequence without a known pair is done and counts the symbols left.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows with the same id
are counted each on its own; an empty table gives no rows; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import text_or_empty
from spanloom.llm.ragged import merge
from spanloom.llm.vocabularies import Memory, PairTable, merge_list, piece_pattern, public_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# Bytes of unknown pieces that are merged in one go.
ROOM = 1_000_000


def merged_lengths(pieces: list[bytes], symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols that remain of each piece (none empty) when no pair is left."""
    return merge(symbols[np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces]), table)


class Counter:
    def __init__(self, path: str) -> None:
        import regex

        self.symbols, self.table, special = merge_list(path)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = Memory()

    def learn(self, pieces: set[str]) -> None:
        part: list[str] = []
        room = ROOM
        for piece in chain(pieces, [None]):
            if part and (piece is None or room < 0):
                sizes = merged_lengths([p.encode() for p in part], self.symbols, self.table)
                self.known.learn(part, sizes.tolist())
                part, room = [], ROOM
            if piece is not None:
                part.append(piece)
                room -= 4 * len(piece)

    def counts(self, texts: list[str]) -> list[int]:
        split = piece_pattern().findall
        out = []
        self.known.tidy()
        # A bounded stretch of text at a time, so the pieces of a batch never lie in memory together.
        begin, n = 0, len(texts)
        while begin < n:
            end, held = begin, 0
            while end < n and held < 4_000_000:
                held += len(texts[end])
                end += 1
            rows, extra = [], []
            for text in texts[begin:end]:
                found = self.special.split(text) if self.special and self.special.search(text) else [text]
                extra.append(len(found) - 1)
                rows.append(split(text) if len(found) == 1 else list(chain.from_iterable(map(split, found))))
            self.learn(set().union(*rows).difference(self.known.of))
            known = self.known.of.__getitem__
            out += [e + sum(map(known, row)) for e, row in zip(extra, rows, strict=True)]
            begin = end
        return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; special strings in a text count as one token each."""
    path = path or public_path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
