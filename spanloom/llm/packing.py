"""Packing documents into sequences of bounded length by large-item matching.

Pieces longer than a third of a sequence share it with at most one other of their kind:
going from the longest down, each takes the longest partner that still fits.  Smaller
pieces, longest first, go into the smallest gap that takes them; what fits nowhere
opens sequences of its own.

Only lengths matter for that, and there are at most ``capacity`` of them.  So Spark
counts the pieces of each length, the plan is made for these counts (many like sequences
at a time), and every piece finds its place by its number among the pieces of its
length.  The plan has a bounded number of lines, whatever the number of documents.

Defined results: null and empty texts are one id (the end mark); rows with the same id
are packed each on its own; an empty table gives no rows; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import stored, text_or_empty
from spanloom.llm.ragged import merge
from spanloom.llm.vocabularies import Memory, byte_letters, merge_list, public_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
WORD_END = "</w>"  # fixed value of the vocabulary

# Texts of these characters only are the same after Unicode composition, and their words can be told by
# the plain patterns below; any other text goes through the tokenizer as a whole.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\|")
_NUMBERS = "²³¹¼½¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_NUMBERS}]+|[\d{_NUMBERS}]|(?:[^\s\w]|_)+")


class WordIds:
    """Ids of texts as the tokenizer gives them.

    Plain words are merged here, all new ones of a batch at once, and looked up from then
    on; a text with anything else goes to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.inner, self.table, _ = merge_list(path)
        last = byte_letters()
        self.final = np.array([self.tokenizer.token_to_id(last[b] + WORD_END) for b in range(256)], np.int32)
        self.known = Memory()

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        self.known.tidy()
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and held < 2_000_000:
                held += len(texts[end])
                end += 1
            part = texts[begin:end]
            rows = [None if OTHER.search(t) else WORDS.findall(t.lower()) for t in part]
            new = list(set().union(*(r for r in rows if r)).difference(self.known.of))
            self.known.learn(new, self._merged([w.encode() for w in new]))
            known = self.known.of.__getitem__
            for text, row in zip(part, rows, strict=True):
                if row is None:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                    yield np.array(ids, "<u4").tobytes()
                else:
                    yield b"".join(map(known, row))
            begin = end

    def _merged(self, words: list[bytes]) -> Iterator[bytes]:
        if not words:
            return
        length = np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8)
        sym, ends = self.inner[letters], np.cumsum(length) - 1
        sym[ends] = self.final[letters[ends]]
        counts, ids = merge(sym, length, self.table, keep=True)
        whole, at = ids.astype("<u4").tobytes(), 0
        for n in counts.tolist():
            yield whole[at : at + 4 * n]
            at += 4 * n


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end mark, cut only where too long."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mark = WordIds(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.packed(batch.column("text").to_pylist()),
                                strict=True):
                ids += mark
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(out, columns, strict=True)],
                columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Alike:
    """So many sequences of one filling: (length, pieces of it) from the front."""

    count: int
    gap: int
    filling: list[tuple[int, int]] = field(default_factory=list)

    def taking(self, length: int, each: int, count: int) -> Alike:
        return Alike(count, self.gap - length * each, [*self.filling, (length, each)])


def plan(counts: dict[int, int], capacity: int) -> list[Alike]:
    """Fillings for so many pieces of each length; all pieces are placed."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    by_gap: dict[int, list[Alike]] = {}
    gaps: list[int] = []

    def put(some: Alike) -> None:
        if some.count:
            if some.gap not in by_gap:
                insort(gaps, some.gap)
                by_gap[some.gap] = []
            by_gap[some.gap].append(some)

    empty = Alike(0, capacity)
    for n in reversed(large):
        while left[n]:
            fits = next((m for m in reversed(large) if m <= capacity - n and left[m] and (m != n or left[n] > 1)), None)
            if fits is None:
                put(empty.taking(n, 1, left[n]))
                left[n] = 0
            elif fits == n:
                put(empty.taking(n, 2, left[n] // 2))
                left[n] %= 2
            else:
                both = min(left[n], left[fits])
                put(empty.taking(n, 1, both).taking(fits, 1, both))
                left[n] -= both
                left[fits] -= both
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                put(empty.taking(n, each, todo // each))
                if todo % each:
                    put(empty.taking(n, todo % each, 1))
                break
            some = by_gap[gaps[k]].pop()
            if not by_gap[some.gap]:
                del by_gap[some.gap], gaps[k]
            each = some.gap // n
            full = min(some.count, todo // each)
            put(some.taking(n, each, full))
            todo -= full * each
            rest = some.count - full
            if rest and todo and todo < each:
                put(some.taking(n, todo, 1))
                rest, todo = rest - 1, 0
            put(Alike(rest, some.gap, some.filling))
    return [some for g in gaps for some in by_gap[g]]


def plan_lines(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, each, first_sequence, offset): the pieces of a length numbered first..last lie ``each``
    to a sequence from first_sequence on, beginning at offset."""
    used: dict[int, int] = {}
    lines, sequence = [], 0
    for some in plan(counts, capacity):
        offset = 0
        for length, each in some.filling:
            first = used.get(length, 0)
            used[length] = first + each * some.count
            lines.append((length, first, used[length] - 1, each, sequence, offset))
            offset += length * each
        sequence += some.count
    return lines


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, from 0 on among the rows of a length; common lengths are counted in many parts."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = rows.withColumn("place", F.row_number().over(
        Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return inside.join(before.drop("n"), ["length", "part"]).withColumn(
        "number", F.coalesce("before", F.lit(0)) + F.col("place")).drop("part", "before", "place")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = stored(pieces(docs, path or public_path(VOCABULARY), capacity), "pieces")
    # At most ``capacity`` counts come to the driver.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = plan_lines(counts, capacity)
    schema = "length long, first long, last long, each long, sequence long, base long"
    lines_df = spark.createDataFrame(lines, schema)
    place = F.col("number") - F.col("first")
    # The plan is bounded by the number of lengths, so every task may hold it.
    return numbered(rows).join(F.broadcast(lines_df), "length").where("number between first and last").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + place % F.col("each") * F.col("length")).cast("long").alias("offset"))
