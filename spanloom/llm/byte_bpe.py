"""Byte-level encoding by ranks, and decoding.

Pre-tokens that are no token themselves go, by length, into padded numpy matrices of
symbols.  In a round every row merges its leftmost pair of least rank; pairs are found
in a hash table, and the cells behind a merge move up.  Rows that are done leave.

Defined results: null text counts as empty (no ids, both digests those of nothing);
rows with the same id are encoded each on its own; an empty table gives no rows;
special strings are ordinary text; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import text_or_empty
from spanloom.llm.vocabularies import Memory, PairTable, piece_pattern, public_path, ranked_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
# Cells of one matrix, and the longest row that goes into one.
CELLS, LONGEST = 400_000, 1_024


def merge_rows(rows: list[bytes], symbols: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Ids of rows of similar length (none empty)."""
    width = max(map(len, rows))
    length = np.array([len(r) for r in rows], np.int64)
    cell = np.arange(width)
    inside = cell < length[:, None]
    sym = np.zeros((len(rows), width), np.int32)
    sym[inside] = symbols[np.frombuffer(b"".join(rows), np.uint8)]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
    who = np.arange(len(rows))
    at = np.full(sym.shape, -1, np.int64)
    at[:, :-1] = table.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(rows), width - 1)
    at[cell + 1 >= length[:, None]] = -1
    while len(who):
        rank = np.where(at >= 0, table.rank[at], PairTable.ABSENT)
        best = rank.argmin(axis=1)  # the first of the least
        line = np.arange(len(who))
        done = rank[line, best] == PairTable.ABSENT
        if done.any():
            for k in np.flatnonzero(done):
                out[who[k]] = sym[k, : length[k]].copy()
            go = ~done
            who, sym, at, length, best = who[go], sym[go], at[go], length[go], best[go]
            if not len(who):
                break
            wide = int(length.max())
            sym, at, line = sym[:, :wide], at[:, :wide], np.arange(len(who))
        cell = np.arange(sym.shape[1])
        sym[line, best] = table.made[at[line, best]]
        # Compaction: what lies behind the merged pair moves up one cell.
        source = np.minimum(cell + (cell > best[:, None]), sym.shape[1] - 1)
        sym = np.take_along_axis(sym, source, 1)
        at = np.take_along_axis(at, source, 1)
        length -= 1
        after = np.flatnonzero(best + 1 < length)
        at[line, best] = -1
        at[after, best[after]] = table.find(sym[after, best[after]], sym[after, best[after] + 1])
        before = np.flatnonzero(best > 0)
        at[before, best[before] - 1] = table.find(sym[before, best[before] - 1], sym[before, best[before]])
    return out


def merge_long(row: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The same for a row too long for a matrix: pairs in a heap by rank and place."""
    n = len(row)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the symbol that begins here; 0 once merged away

    def pair(i: int):
        j = after[i]
        return (ranks[row[i : end[j]]], i, end[i], end[j]) if j < n and row[i : end[j]] in ranks else None

    heap = [p for p in map(pair, range(n)) if p]
    heapify(heap)
    while heap:
        _, i, mid, stop = heappop(heap)
        j = after[i] if end[i] == mid else n
        if j >= n or end[j] != stop:
            continue  # one of the two has changed since
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (p := pair(k)):
                heappush(heap, p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[row[i : end[i]]])
        i = after[i]
    return np.array(ids, np.int32)


class Codec:
    def __init__(self, path: str) -> None:
        self.symbols, self.table, self.ranks, self.texts = ranked_bytes(path)
        self.known = Memory()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        order = []
        for k, piece in enumerate(pieces):
            if piece in self.ranks:
                out[k] = np.array([self.ranks[piece]], np.int32)
            elif len(piece) > LONGEST:
                out[k] = merge_long(piece, self.ranks)
            else:
                order.append(k)
        order.sort(key=lambda k: len(pieces[k]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin) * len(pieces[order[end]]) < CELLS \
                    and len(pieces[order[end]]) <= 1.25 * len(pieces[order[begin]]) + 1:
                end += 1
            for k, ids in zip(order[begin:end], merge_rows([pieces[k] for k in order[begin:end]], self.symbols,
                                                           self.table), strict=True):
                out[k] = ids
            begin = end
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = piece_pattern().findall
        self.known.tidy()
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and held < 2_000_000:
                held += len(texts[end])
                end += 1
            rows = list(map(split, texts[begin:end]))
            new = list(set().union(*rows).difference(self.known.of))
            self.known.learn(new, (x.astype("<i4").tobytes() for x in self.encode_pieces([p.encode() for p in new])))
            known = self.known.of.__getitem__
            for row in rows:
                yield b"".join(map(known, row))
            begin = end

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (an array) of every text."""
    path = path or public_path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in codec.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        encode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    path = path or public_path(VOCABULARY)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for packed in codec.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(packed, "<i4").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
