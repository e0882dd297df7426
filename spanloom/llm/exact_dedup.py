"""Exact duplicates with static filters over immutable snapshots.

A snapshot is a set of digests that never changes again, cut into buckets by the
digest; each bucket holds one static filter (three hashed slots of eight bits per
key, as in a binary fuse filter).  A new batch is grouped on its own first, so a
digest with many copies is one row; the filters screen those rows, and only what
they let through is joined with the snapshot and compared byte by byte.

Defined results: null text counts as empty, so null and empty texts are one group;
rows of one id stay or go together, and count one by one in the size of a group; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import stored, text_or_empty

# Distinct digests that a filter bucket should hold; the number of buckets follows the input.
BUCKET_KEYS = 2_048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        texts = batch.column(1).to_pylist()
        digests = [hashlib.sha256((t or "").encode().lower()).digest() for t in texts]  # bytes.lower: A-Z only
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def digested(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z in lower case."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        normalised, "doc_id long, digest binary")


# -- the filter ------------------------------------------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def layout(n: int) -> tuple[int, int]:
    """Slots in a segment and number of segments that keys start in."""
    segment = 1 << max(4, min(16, int(np.log2(max(n, 2)) / 1.74 + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))) + 32
    return segment, max(1, -(-size // segment) - 2)


def slots(h: np.ndarray, segment: int, starts: int) -> np.ndarray:
    """Three slots of each key, in neighbouring segments, so that a lookup touches few cache lines."""
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    at = [(first + np.uint64(k)) * np.uint64(segment) + ((h >> np.uint64(18 * k)) & low) for k in range(3)]
    return np.stack(at).astype(np.int64)


def prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, bytes]:
    """Seed and slots of a filter over distinct 64-bit keys.

    Keys are peeled in rounds: every slot that only one key uses gives that key its
    place; the rounds are then undone from the last to the first.
    """
    keys = np.unique(keys)
    segment, starts = layout(len(keys))
    for seed in range(1, 200):
        h = mixed(keys, seed)
        at = slots(h, segment, starts)
        size = (starts + 2) * segment
        left = np.arange(len(keys))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        while len(left):
            uses = np.bincount(at[:, left].ravel(), minlength=size)
            alone = uses[at[:, left]] == 1
            free = alone.any(axis=0)
            if not free.any():
                break
            own = at[:, left][alone.argmax(axis=0), np.arange(len(left))]
            rounds.append((left[free], own[free]))
            left = left[~free]
        if len(left):
            continue
        held = np.zeros(size, np.uint8)
        mark = prints(h)
        for who, own in reversed(rounds):
            held[own] = 0
            held[own] = mark[who] ^ held[at[0, who]] ^ held[at[1, who]] ^ held[at[2, who]]
        return seed, held.tobytes()
    raise RuntimeError("no seed peels the keys")


def may_hold(keys: np.ndarray, n: int, seed: int, held: bytes) -> np.ndarray:
    if not n:
        return np.zeros(len(keys), bool)
    h = mixed(keys, seed)
    at = slots(h, *layout(n))
    got = np.frombuffer(held, np.uint8)
    return (got[at[0]] ^ got[at[1]] ^ got[at[2]]) == prints(h)


def keys_of(digests) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8") if len(digests) else np.zeros(0, np.uint64)


# -- Spark steps -----------------------------------------------------------------------------------

def bucket(digest: str, buckets: int):
    return F.expr(f"pmod(xxhash64({digest}), {buckets})")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of a snapshot of distinct digests; written once, never changed."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(keys_of(frame["digest"].tolist()))
        seed, held = build_filter(keys)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1].values, "n_keys": [len(keys)], "seed": [seed],
                             "held": [held]})

    return snapshot.select("digest", bucket("digest", buckets).alias("bucket")).groupBy("bucket").applyInPandas(
        build, "bucket long, n_keys long, seed long, held binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of a batch that a snapshot may hold; none that it holds is left out."""

    def test(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(held):
            return rows[["digest"]].iloc[:0]
        f = held.iloc[0]
        return rows.loc[may_hold(keys_of(rows["digest"].tolist()), int(f["n_keys"]), int(f["seed"]), f["held"]), ["digest"]]

    left = batch.select("digest", bucket("digest", buckets).alias("bucket")).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest binary")


def grouped(rows: DataFrame) -> DataFrame:
    """A batch on its own: one row a digest, summed where the rows lie before they are sent."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (digest, old_batch, new_id, old_id), those whose texts are the same bytes after lower-casing A-Z.

    Other texts under the same ids have other digests and are passed over.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("raw"))
    sides = pairs.select("digest", "old_batch", F.explode(F.array("new_id", "old_id")).alias("doc_id"))
    seen = texts.join(sides, "doc_id").select("digest", "old_batch", F.translate("raw", UPPER, LOWER).alias("norm")).where(
        F.unhex(F.sha2("norm", 256)) == F.col("digest"))
    return seen.groupBy("digest", "old_batch").agg(F.min("norm").alias("a"), F.max("norm").alias("b")) \
        .where("a = b").select("digest", "old_batch")


def deduplicate(docs: DataFrame, batches: int = 2, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    The rows come as ``batches`` deliveries, dealt by a hash of doc_id.  Each delivery is
    screened against the snapshots of the earlier ones; the row with the largest doc_id of
    equal texts stays, whichever delivery brought it.  A digest whose bytes differ from the
    snapshot's would stay a group of its own delivery.
    """
    rows = stored(digested(docs).withColumn("batch", F.expr(f"cast(pmod(xxhash64(doc_id), {batches}) as int)")),
                  "digests")
    buckets = max(1, -(-rows.count() // (batches * bucket_keys)))
    parts: list[DataFrame] = []
    snapshots: list[tuple[DataFrame, DataFrame]] = []
    for b in range(batches):
        new = stored(grouped(rows.where(F.col("batch") == b)), "batch")
        home = new.withColumn("batch", F.lit(b))
        pairs = [new.join(screen(new, filters, buckets), "digest", "left_semi")
                 .select("digest", F.col("keep_id").alias("new_id"))
                 .join(old.select("digest", F.col("keep_id").alias("old_id")), "digest")
                 .withColumn("old_batch", F.lit(a)) for a, (old, filters) in enumerate(snapshots)]
        if pairs:
            same = confirmed(reduce(DataFrame.unionByName, pairs), docs).groupBy("digest").agg(
                F.min("old_batch").alias("home"))
            parts.append(home.join(same, "digest", "left").withColumn("home", F.coalesce("home", "batch")))
        else:
            parts.append(home.withColumn("home", F.col("batch")))
        if b < batches - 1:
            snapshots.append((new, stored(build_filters(new, buckets), "filters")))
    members = stored(reduce(DataFrame.unionByName, parts), "groups")
    whole = members.groupBy("digest", "home").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Written, so that the join below sends both sides anew and hot groups can be split.
    groups = stored(members.select("digest", "batch", "home").join(whole, ["digest", "home"]), "groups")
    return rows.join(groups, ["digest", "batch"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    stay = deduplicate(docs).where("kept").select(F.col("doc_id").alias("_stay"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
