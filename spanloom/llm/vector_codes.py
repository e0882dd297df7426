"""Vector codes by product quantisation, with Lloyd's rounds over resident members.

A vector of whole numbers is cut into consecutive parts, and each position has a codebook
of at most 256 entries.  The parts live where their entry is owned: an owner is a position,
an entry and a salt, and the partition follows from it, so a part stays in its place while
its entry stays.  In a round every partition compares its resident parts with the codebook
(at most 4 x 256 entries, in the task's closure), only the parts whose entry has changed go
to their new owner in a shuffle, and the owners then add up their residents for the new
entries; partial sums of all owners meet in a tree of additions.

The salt is a number of the row, and position, entry and salt are added up for the
partition, so an entry that holds a third of all parts, or all, lies in all partitions
alike.  A partition holds about ``RESIDENT`` parts.  The residents of a round are kept and
checkpointed in the shared folder; a lost executor costs the last round at most.

Distances and sums are exact: in doubles while they stay whole there, else in Python's
integers.  Defined results: vectors that are null, empty, hold null or non-finite components
or such of 2**52 and more, or have another length than most, take no part; fewer than 256
vectors give codebooks of as many entries; rows with the same vec_id count each on their own
(for the start by vector then, null ids last); an error beyond a long is null; a length that
the number of parts does not divide is refused; an empty table gives no rows; columns
besides vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm.common import shared_dir, stored
from spanloom.llm.whole_vectors import whole_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4
RESIDENT = 1 << 18
# Distances of this many parts are held at a time.
COMPARED = 1 << 13
# Whole numbers up to this are exact in doubles, and up to the next in longs.
DOUBLES, LONGS = 1 << 53, (1 << 63) - 1


# Parts of vectors, as plain arrays of one length: row number, position, entry, components (a row each).
Members = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def some(members: Members, chosen: np.ndarray) -> Members:
    return tuple(column[chosen] for column in members)


def owners(members: Members, width: int) -> np.ndarray:
    """The partition of each: next salts of an entry lie in next partitions, and so do next entries of a salt."""
    rows, positions, entries, _ = members
    return (positions + PARTS * (entries.astype(np.int64) + salt(rows))) % width


def salt(rows: np.ndarray) -> np.ndarray:
    """A number of the row in 31 bits, mixed, since row numbers come in runs."""
    mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return mixed.astype(np.int64)


def joined(pieces: list[Members]) -> Members:
    return tuple(np.concatenate(columns) for columns in zip(*pieces))


def size_of(*arrays: np.ndarray) -> int:
    return max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)


def closest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` and the squared distance (-1 beyond a long), for each of ``parts``.

    Ties go to the lower index.
    """
    entry, distance = np.empty(len(parts), np.int16), np.empty(len(parts), np.int64)
    if 4 * parts.shape[1] * size_of(parts, book) ** 2 >= DOUBLES:
        exact = book.astype(object)
        for k, part in enumerate(parts.astype(object)):
            far = ((exact - part) ** 2).sum(axis=1).tolist()
            best = min(far)
            entry[k], distance[k] = far.index(best), best if best <= LONGS else -1
        return entry, distance
    b = book.astype(np.float64)
    norms = (b * b).sum(axis=1)
    for start in range(0, len(parts), COMPARED):
        a = parts[start : start + COMPARED].astype(np.float64)
        best = (norms - 2 * (a @ b.T)).argmin(axis=1)
        entry[start : start + len(a)] = best
        distance[start : start + len(a)] = ((a - b[best]) ** 2).sum(axis=1)
    return entry, distance


def nearest_entries(members: Members, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    _, positions, _, parts = members
    entry, distance = np.empty(len(parts), np.int16), np.empty(len(parts), np.int64)
    for position, book in enumerate(books):
        mine = positions == position
        entry[mine], distance[mine] = closest(parts[mine], book)
    return entry, distance


def sums_of(members: Members, entries: int) -> np.ndarray:
    """Components' sums, then the count, of the residents of each entry (position by position), as exact integers."""
    _, positions, entry, parts = members
    key = positions.astype(np.int64) * entries + entry
    out = np.zeros((PARTS * entries, parts.shape[1] + 1), object)
    if len(key) * size_of(parts) < DOUBLES:
        for j, values in enumerate(parts.T):
            out[:, j] = np.bincount(key, values, PARTS * entries).astype(np.int64)
    else:
        np.add.at(out[:, :-1], key, parts.astype(object))
    out[:, -1] = np.bincount(key, minlength=PARTS * entries)
    return out


def moved_on(books: list[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """New entries: the floor of each mean; an entry without members stays."""
    out = []
    for book, of in zip(books, sums.reshape(len(books), len(books[0]), -1)):
        new = book.copy()
        for k, row in enumerate(of):
            if row[-1]:
                new[k] = [int(s) // int(row[-1]) for s in row[:-1]]
        out.append(new)
    return out


def settled(rows: DataFrame, books: list[np.ndarray], width: int) -> RDD[Members]:
    """All parts at the owners of their first entries, one block of them a partition."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            if size_of(x) < 1 << 31:
                x = x.astype(np.int32)
            row = np.repeat(batch.column("row_id").to_numpy(), PARTS)
            positions, parts = np.tile(np.arange(PARTS, dtype=np.int8), len(x)), x.reshape(len(row), -1)
            entry = nearest_entries((row, positions, row, parts), books)[0]
            to = sent((row, positions, entry, parts), width)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in to], pa.int32()),
                                              pa.array([pickle.dumps(m) for _, m in to], pa.binary())], ["owner", "members"])

    dealt = rows.select("row_id", "x").mapInArrow(deal, "owner int, members binary").rdd
    return dealt.map(lambda r: (r[0], pickle.loads(r[1]))).partitionBy(width, int).mapPartitions(gathered)


def sent(members: Members, width: int) -> list[tuple[int, Members]]:
    owner = owners(members, width)
    order = owner.argsort(kind="stable")
    targets, starts = np.unique(owner[order], return_index=True)
    return [(int(t), some(members, part)) for t, part in zip(targets, np.split(order, starts[1:]))]


def gathered(arrived: Iterator[tuple[int, Members]]) -> Iterator[Members | None]:
    pieces = [m for _, m in arrived]
    yield joined(pieces) if pieces else None


def reassigned(state: RDD[Members], books: list[np.ndarray], width: int) -> tuple[RDD, RDD[Members]]:
    """(compared, residents): each part compared with ``books``; those of another entry have gone to its owner."""
    def compare(members: Members | None) -> tuple[Members | None, list[tuple[int, Members]]]:
        if members is None:
            return None, []
        rows, positions, entry, parts = members
        now = rows, positions, nearest_entries(members, books)[0], parts
        leaves = now[2] != entry
        return some(now, ~leaves), sent(some(now, leaves), width)

    compared = state.map(compare).persist(StorageLevel.MEMORY_AND_DISK)
    arrived = compared.flatMap(lambda c: c[1]).partitionBy(width, int).mapPartitions(gathered)

    def merged(both: tuple) -> Members | None:
        pieces = [m for m in (both[0][0], both[1]) if m is not None]
        return joined(pieces) if pieces else None

    return compared, compared.zip(arrived).map(merged)


def trained(spark: SparkSession, rows: DataFrame, books: list[np.ndarray], n: int) -> tuple[RDD[Members], list[np.ndarray]]:
    """Residents and codebooks after the rounds."""
    shared_dir(spark)
    entries = len(books[0])
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-PARTS * n // RESIDENT))
    width = PARTS * -(-wanted // PARTS)
    state, done = settled(rows, books, width), []
    for after in range(1, ROUNDS + 1):
        state.persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        held = state.filter(lambda m: m is not None).map(lambda m: sums_of(m, entries))
        books = moved_on(books, held.treeReduce(np.add))
        for earlier in done:
            earlier.unpersist()
        if after < ROUNDS:
            compared, following = reassigned(state, books, width)
            done, state = [state, compared], following
    return state, books


def assigned(spark: SparkSession, state: RDD[Members], books: list[np.ndarray]) -> DataFrame:
    """row_id, position, entry and error of every part, by the last codebooks."""
    def packed(members: Members) -> tuple[bytes, bytes, bytes, bytes]:
        entry, distance = nearest_entries(members, books)
        return members[0].tobytes(), members[1].tobytes(), entry.tobytes(), distance.tobytes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows, positions, entry, distance = (np.frombuffer(b, t) for b, t in zip(row, ("<i8", "i1", "<i2", "<i8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(positions.astype(np.int32)), pa.array(entry.astype(np.int32)),
                     pa.array(distance, mask=distance < 0)], ["row_id", "position", "entry", "error"])

    blocks = spark.createDataFrame(state.filter(lambda m: m is not None).map(packed),
                                   "a binary, b binary, c binary, d binary")
    return blocks.mapInArrow(spread, "row_id long, position int, entry int, error long")


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every vector that takes part."""
    spark, types = vectors.sparkSession, dict(vectors.dtypes)
    rows, n, dim = whole_vectors(vectors, "codes", keep=("label",))
    if not n:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, code string, error long, label_error long, "
                                         "codebooks_sha256 string")
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components have no {PARTS} equal parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1)
    state, books = trained(spark, rows, [start[:, k] for k in range(PARTS)], n)
    parts = stored(assigned(spark, state, books), "assigned")
    state.unpersist()
    whole = parts.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("entries"),
        F.when(F.count("error") == PARTS, F.sum(F.col("error").cast("decimal(20,0)"))).try_cast("long").alias("error"))
    coded = stored(rows.select("row_id", "vec_id", "label").join(whole, "row_id").select(
        "vec_id", "label", F.array_join(F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e["entry"]), 2, "0"))), "").alias("code"),
        "error"), "coded")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.when(
        F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(20,0)"))).try_cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
