"""Shards of near equal bytes: minimax partition of ordered groups, cut at the smallest feasible capacity.

Equal texts are one atomic group, so copies never part.  Groups stand in the order of their
text's SHA-256 digest, which mixes sources and lengths.  The smallest capacity such that
the ordered groups fit into the shards is found by binary search; each step checks greedily,
filling a shard up to the capacity and going on with the next.  A group as large as an equal
share of what is left has a shard of its own beforehand, since it would set the capacity for
all others too.  Among the cuts that keep the capacity, those nearest to equal shares are
taken; the plain greedy ones would leave all slack to the last shard.

Only sums over the order matter for the check: it asks for the last group that ends at or
before a byte position.  Spark holds the running sums; the driver holds an outline of them,
ranges of positions with the first and last sum in each (at most ``OUTLINE`` at first).  The
search runs on the outline, notes which ranges it would have to look into, Spark refines
those, and the search runs again, until it meets no open range.  The answer is then that on
all sums.  A shard's place is a comparison of a row's digest with the cuts, so rows are not
shuffled, and slots are numbered part by part.

Defined results: null texts count as empty, size 1; rows are placed each on their own, with
their doc_id null or repeated too; fewer groups than shards leave shards empty; ``law`` is
``bytes`` and ``grown_shard`` null; an empty table gives no rows; columns besides doc_id and
text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import stored, text_or_empty

SHARDS = 16
# Ranges of the first outline, and pieces into which a range is refined.
OUTLINE, PIECES = 1 << 15, 1 << 8
# Groups of about so many share a prefix of the digest and are summed in one task.
GROUPS = 1 << 15


class Outline:
    """Ranges of increasing sums, in order: (first sum, last sum, how many)."""

    def __init__(self, ranges: list[tuple[int, int, int]], total: int) -> None:
        self.ranges, self.total = ranges, total
        self.firsts, self.lasts = [r[0] for r in ranges], [r[1] for r in ranges]
        self.open: set[int] = set()

    def last_within(self, position: int) -> int:
        """The largest sum at or below ``position``, 0 without one; in an open range its first."""
        k = bisect_right(self.firsts, position) - 1
        if k < 0:
            return 0
        first, last, count = self.ranges[k]
        if position >= last:
            return last
        if count > 2:
            self.open.add(k)
        return first

    def first_from(self, position: int) -> int:
        """The least sum at or above ``position``; in an open range its last."""
        if position <= 0:
            return 0
        k = bisect_left(self.lasts, position)
        if k == len(self.ranges):
            return self.total
        first, last, count = self.ranges[k]
        if position <= first:
            return first
        if count > 2:
            self.open.add(k)
        return last

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.last_within(at + capacity)
        return at >= self.total


def smallest_capacity(sums: Outline, shards: int, largest: int) -> int:
    low = max(largest, -(-sums.total // shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sums.fits(middle, shards) else (middle + 1, high)
    return low


def cuts_within(sums: Outline, capacity: int, shards: int) -> list[int]:
    """``shards`` - 1 sums to cut after: no shard above the capacity, each cut as near to an equal share as that allows."""
    earliest = [sums.total]
    for _ in range(shards - 1):
        earliest.append(sums.first_from(earliest[-1] - capacity))
    found, at, furthest = [], 0, 0
    for k, least in enumerate(reversed(earliest[1:]), start=1):
        furthest = sums.last_within(furthest + capacity)
        most = min(furthest, sums.last_within(at + capacity))
        share = min(max(sums.total * k // shards, least), most)
        below, above = sums.last_within(share), sums.first_from(share)
        choices = [c for c in (below, above) if max(least, at) <= c <= most] or [most]
        at = min(choices, key=lambda c: (abs(c - sums.total * k // shards), c))
        found.append(at)
    return found


def running_sums(groups: DataFrame, count: int) -> DataFrame:
    """key and end: the sum of bytes of all groups up to this one, by key, prefix by prefix."""
    letters = max(2, int(np.ceil(np.log(max(count / GROUPS, 1)) / np.log(16))))
    named = groups.withColumn("prefix", F.substring("key", 1, letters))
    totals = named.groupBy("prefix").agg(F.sum("bytes").alias("all"))
    # One row a prefix; the prefixes themselves are summed by their first letters in turn.
    head = F.substring("prefix", 1, max(letters - 3, 1))
    heads = totals.groupBy(head.alias("head")).agg(F.sum("all").alias("all"))
    heads = heads.select("head", (F.sum("all").over(Window.orderBy("head")) - F.col("all")).alias("behind"))
    inside = F.sum("all").over(Window.partitionBy("head").orderBy("prefix")) - F.col("all")
    starts = totals.withColumn("head", head).withColumn("inside", inside).join(heads, "head").select(
        "prefix", (F.col("behind") + F.col("inside")).alias("start"))
    within = F.sum("bytes").over(Window.partitionBy("prefix").orderBy("key"))
    return named.withColumn("within", within).join(starts, "prefix").select(
        "key", (F.col("start") + F.col("within")).alias("end"))


def outline(sums: DataFrame, edges: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Ranges of ``width`` positions inside the given ones (first, last), each with its sums' first, last and number."""
    # The given ranges are apart, so a sum lies in one at most; which one, a search in a short sorted list tells.
    lows, highs = np.array(edges, np.int64).T

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = batch.column("end").to_numpy()
            at = np.searchsorted(lows, end, "right") - 1
            inside = (at >= 0) & (end <= highs[at])
            end, at = end[inside], at[inside]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((end - lows[at]) // width), pa.array(end)],
                                             ["range", "piece", "end"])

    found = sums.select("end").mapInArrow(ranges, "range long, piece long, end long").groupBy("range", "piece").agg(
        F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
    return sorted((r["first"], r["last"], r["n"]) for r in found.collect())


def plan(sums: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The sums to cut after, exact, with a bounded part of them on the driver at a time."""
    width = -(-total // OUTLINE)
    ranges = outline(sums, [(1, total)], width)
    while True:
        known = Outline(ranges, total)
        cuts = cuts_within(known, smallest_capacity(known, shards, largest), shards)
        if not known.open:
            return cuts
        unclear = [ranges[k] for k in known.open]
        width = max(1, -(-max(last - first + 1 for first, last, _ in unclear) // PIECES))
        finer = outline(sums, sorted((first, last) for first, last, _ in unclear), width)
        ranges = sorted([r for k, r in enumerate(ranges) if k not in known.open] + finer)


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard.

    A part counts its rows of each shard as it writes them, and starts where the parts before it end.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            place = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = shard == s
                more = int(mine.sum())
                place[mine] = np.arange(seen.get(s, 0), seen.get(s, 0) + more)
                seen[s] = seen.get(s, 0) + more
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part), pa.int32()), pa.array(place)],
                                             [*batch.schema.names, "part", "place"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    placed = stored(rows.mapInArrow(count, f"{kinds}, part int, place long"), "placed")
    held = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = held.select("shard", "part", before.alias("start"))
    return placed.join(starts, ["shard", "part"]).withColumn("slot", F.col("start") + F.col("place")).select(*columns)


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = text_or_empty()
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("key")), "sized")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    facts = groups.agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("n")).first()
    left, alone = facts["total"] or 0, []
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    for group in top:
        if shards - len(alone) > 1 and group["bytes"] * (shards - len(alone)) >= left:
            alone.append(group["key"])
            left -= group["bytes"]
        else:
            break
    cut_keys: list[str] = []
    if left and shards - len(alone) > 1:
        rest = groups.where(~F.col("key").isin(alone)) if alone else groups
        sums = stored(running_sums(rest, facts["n"]), "sums")
        cuts = plan(sums, left, top[len(alone)]["bytes"], shards - len(alone))
        keys = {r["end"]: r["key"] for r in sums.where(F.col("end").isin(sorted(set(cuts)))).collect()}
        cut_keys = [keys.get(c, "") for c in cuts]  # a cut at 0 lies before all keys
    shard = F.lit(len(alone))
    for key in cut_keys:
        shard = shard + (F.col("key") > key).cast("int")
    for k, key in reversed(list(enumerate(alone))):
        shard = F.when(F.col("key") == key, k).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"),
                         F.lit(None).cast("int").alias("grown_shard"))
    return numbered(placed, ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
