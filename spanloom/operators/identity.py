"""Assigning stable ids to the objects of consecutive frames."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.operators.nearest import DISTANCE_DIGITS, TILE_ROWS, nearest_earlier, unit
from spanloom.operators.prefix import CHUNK, number_rows, prefix_max, prefix_sum

NEW = "new"


ANY, UNKNOWN = "any", "unknown"


class Free:
    """The known objects that no object of the frame has taken yet, found by class and block.

    A new object takes the first one of its class whose blocks meet its own, or where either's
    are unknown; failing that the first of its class.  Each list is gone through once a frame.
    """

    def __init__(self, context: list[tuple[int, str, list[int]]]) -> None:
        self.known = {i: (c, set(b)) for i, c, b in context}
        self.lists: dict[tuple[str, str | int], deque[tuple[int, int]]] = {}
        for place, (i, (cls, blocks)) in enumerate(self.known.items()):
            for kind in (ANY, *(blocks or (UNKNOWN,))):
                self.lists.setdefault((cls, kind), deque()).append((place, i))

    def first(self, cls: str, kind: str | int) -> tuple[int, int] | None:
        line = self.lists.get((cls, kind))
        while line and line[0][1] not in self.known:
            line.popleft()
        return line[0] if line else None

    def drop(self, given: int) -> None:
        self.known.pop(given, None)

    def take(self, cls: str, blocks: list[int]) -> int | None:
        found = self.first(cls, ANY) if self.known else None
        if found is None:
            return None
        if len(blocks):
            found = min((h for kind in (UNKNOWN, *blocks) if (h := self.first(cls, kind))), default=found)
        self.drop(found[1])
        return found[1]


def whole_number(raw: str) -> int | None:
    """An id's number; None for other texts and for what the id column cannot hold."""
    if not re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", raw):
        return None
    value = int(raw)
    return value if -(2**31) <= value < 2**31 else None


def resolve_frame(objects: list[tuple[int, str, str, list[int]]],
                  context: list[tuple[int, str, list[int]]]) -> list[tuple[int, int | None]]:
    """(ordinal, id) for the kept objects of one frame; id None asks for a fresh one.

    ``objects``: ordinal, raw id, class, blocks.  A raw id repeated in the frame
    or not a number drops its object.
    """
    free = Free(context)
    taken: set[str] = set()
    out: list[tuple[int, int | None]] = []
    for ordinal, raw, cls, blocks in objects:
        if raw == NEW:
            out.append((ordinal, free.take(cls, blocks)))
        elif raw not in taken:
            taken.add(raw)
            given = whole_number(raw)
            if given is not None:
                free.drop(given)
                out.append((ordinal, given))
    return out


def frames_of(batches: Iterator[pa.RecordBatch], rows_of: Callable[[pa.RecordBatch], list[tuple]]) -> Iterator[tuple]:
    """(recording, frame, its rows) of rows sorted by these two; one batch and one frame are held."""
    current, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("analysis_id").to_pylist(), batch.column("frame").to_pylist()))
        rows, begin = rows_of(batch), 0
        for at, key in enumerate(keys):
            if key != current:
                if current is not None:
                    yield *current, held + rows[begin:at]
                current, held, begin = key, [], at
        held += rows[begin:]
    if current is not None:
        yield *current, held


def lists_of(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(n).to_pylist() for n in names]))


OUT_ROWS = 10_000  # a batch of results


def batches_out(rows: Iterator[tuple], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), shape)], schema=shape)


def _resolved(objects: DataFrame, context: DataFrame) -> DataFrame:
    """analysis_id, frame, r: ordinal, id (null: a fresh one) and the fresh objects before it in the frame."""
    frame_key = ["analysis_id", "frame"]
    known = context.select(*frame_key, F.lit(0).alias("kind"), "place", F.lit(None).cast("int").alias("ordinal"), "class_id",
                           F.lit(None).cast("string").alias("raw_id"), "class", "blocks")
    place = context.schema["place"].dataType
    asking = objects.select(*frame_key, F.lit(1).alias("kind"), F.lit(None).cast(place).alias("place"), "ordinal",
                            F.lit(None).cast("int").alias("class_id"), "raw_id", "class", "blocks")
    rows = known.unionByName(asking).where("analysis_id IS NOT NULL AND frame IS NOT NULL")
    names = ["kind", "place", "ordinal", "class_id", "raw_id", "class", "blocks"]
    key = rows.schema["analysis_id"].dataType
    shape = to_arrow_schema(T.StructType([T.StructField("analysis_id", key), T.StructField(
        "frame", rows.schema["frame"].dataType), T.StructField("r", T.ArrayType(T.IntegerType()))]))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for recording, frame, found in frames_of(batches, lambda b: lists_of(b, names)):
            found = [row for row, _ in groupby(found)]  # copies lie side by side
            free = [(row[3], row[5], row[6]) for row in found if row[0] == 0]
            fresh = 0
            for ordinal, known_id in resolve_frame([(row[2], *row[4:]) for row in found if row[0] == 1], free):
                yield recording, frame, (ordinal, known_id, fresh)
                fresh += known_id is None

    return rows.repartition(*frame_key).sortWithinPartitions(*frame_key, *names).mapInArrow(
        lambda batches: batches_out(matches(batches), shape), T.StructType([
            T.StructField("analysis_id", key), T.StructField("frame", rows.schema["frame"].dataType),
            T.StructField("r", T.ArrayType(T.IntegerType()))]))


def assign_with_context(objects: DataFrame, context: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ids for all frames at once, given each frame's tracking context.

    ``objects``: analysis_id, frame, ordinal, raw_id, class, blocks.  ``context``:
    analysis_id, frame, class_id, class, blocks, place.  Matching looks at one
    frame and its context, so frames run in parallel; rows come to it sorted, so a task
    holds one frame, not a batch of them.  Fresh ids need a
    running counter over the recording, next = max(next + fresh, largest + 1),
    which is a prefix sum and a prefix maximum, both chunked.
    """
    frame_key = ["analysis_id", "frame"]
    # The counters and the numbering all read the matches.  They share the exchange
    # behind the Python step, so matching runs once: the result is one array, since columns
    # that only one reader prunes would undo the sharing.
    resolved = _resolved(objects, context).repartition(*frame_key)
    known = F.col("r")[1]
    counters = resolved.groupBy(*frame_key).agg(
        F.count(F.when(known.isNull(), 1)).alias("fresh"), F.max(known).alias("largest"))
    summed = prefix_sum(counters, ["analysis_id"], "frame", "fresh", "before", chunk)
    floor = summed.withColumn("lift", F.col("largest") + 1 - F.col("before") - F.col("fresh"))
    base = prefix_max(floor, ["analysis_id"], "frame", "lift", "lifted", chunk).select(
        *frame_key, (F.greatest(F.coalesce("lifted", F.lit(1)), F.lit(1)) + F.col("before")).alias("next_id"))
    return resolved.join(base, frame_key).select(
        *frame_key, F.col("r")[0].alias("ordinal"), F.coalesce(known, F.col("next_id") + F.col("r")[2]).cast("int").alias("class_id"),
        known.isNull().alias("fresh"))


class Tracker:
    """Bounded state of one recording: the counter and the last n sampled frames."""

    def __init__(self, n: int, rate: int, cap: int, next_id: int = 1,
                 recent: list[tuple[int, list[tuple[int, str, list[int]]]]] = ()) -> None:
        self.n, self.rate, self.cap = n, rate, cap
        self.next_id = next_id
        self.recent = deque(recent)

    def context(self, frame: int) -> list[tuple[int, str, list[int]]]:
        """Objects of the last n sampled frames, once each, as first seen there; ``cap`` of them at most."""
        while self.recent and self.recent[0][0] < frame - self.n * self.rate:
            self.recent.popleft()
        found: dict[int, tuple[int, str, list[int]]] = {}
        for _, seen in self.recent:
            for entry in seen:
                if len(found) == self.cap:
                    return list(found.values())
                found.setdefault(entry[0], entry)
        return list(found.values())

    def step(self, frame: int, objects: list[tuple]) -> list[tuple[int, int, bool]]:
        """(ordinal, id, fresh) for one frame; frames come in order.

        An object is ordinal, raw id, class, blocks, and what subclasses add.
        """
        context = self.context(frame)[: self.cap]
        by_ordinal = {o[0]: o for o in objects}
        kept: dict[int, int] = {}
        out, largest = [], self.next_id - 1
        for ordinal, known in resolve_frame([o[:4] for o in objects], context):
            fresh = known is None
            if fresh:
                known, self.next_id = self.next_id, self.next_id + 1
            largest = max(largest, known)
            kept[known] = ordinal
            out.append((ordinal, known, fresh))
        self.next_id = max(self.next_id, largest + 1)
        # A context takes at most ``cap`` objects, so of one frame none but its first ``cap``.
        self.recent.append((frame, [(i, by_ordinal[o][2], by_ordinal[o][3]) for i, o in islice(kept.items(), self.cap)]))
        return out


class Remembered(NamedTuple):
    """A detection with a vector, and its nearest entries up to its own frame."""

    frame: int
    ordinal: int
    class_id: int
    cls: str
    blocks: list[int]
    asks: bool
    vector: np.ndarray
    near: list[tuple[float, int, int, str, list[int]]]


class MemoryTracker(Tracker):
    """Recent objects, then those most like them of all earlier frames.

    The k nearest entries of a detection up to its own frame do not depend on ids, so they
    come with it.  What this scan adds is the frames since, whose vectors it still holds, and
    the ids that the entries have been given: of the recording's past it keeps one number a
    detection, no vectors.  Where two detections of a frame end with one id, both are
    remembered, and the last one asks.
    """

    def __init__(self, n: int, rate: int, cap: int, k: int) -> None:
        super().__init__(n, rate, cap)
        self.k = k
        self.ids: dict[tuple[int, int], int] = {}
        self.held: deque[list[Remembered]] = deque()

    def nearest(self, asking: Remembered, frame: int) -> list[tuple[float, int, int, str, list[int]]]:
        """Its k nearest entries (distance, frame, ordinal, class, blocks) before ``frame``."""
        since = [e for entries in self.held for e in entries if asking.frame < e.frame < frame]
        later = [(distance(asking.vector, e.vector), e.frame, e.ordinal, e.cls, e.blocks) for e in since]
        return sorted([*asking.near, *later], key=lambda e: e[:3])[: self.k]

    def context(self, frame: int) -> list[tuple[int, str, list[int]]]:
        recent = super().context(frame)
        while self.held and (not self.held[0] or self.held[0][0].frame < frame - self.n * self.rate):
            self.held.popleft()
        if len(recent) >= self.cap:  # no room for others
            return recent
        best: dict[int, tuple] = {}
        for entries in self.held:
            for one in entries:
                for entry in self.nearest(one, frame) if one.asks else []:
                    class_id = self.ids[entry[1], entry[2]]
                    if class_id not in best or entry[:3] < best[class_id][:3]:
                        best[class_id] = entry
        alike = sorted(best, key=lambda i: (best[i][0], i))[: self.k]
        seen = {i for i, _, _ in recent}
        return recent + [(i, best[i][3], best[i][4]) for i in alike if i not in seen]

    def step(self, frame: int, objects: list[tuple]) -> list[tuple[int, int, bool]]:
        out = super().step(frame, objects)
        by_ordinal = {o[0]: o for o in objects}
        last = {class_id: ordinal for ordinal, class_id, _ in out}
        entries = []
        for ordinal, class_id, _ in out:
            _, _, cls, blocks, vector, near = by_ordinal[ordinal]
            if vector is not None:
                self.ids[frame, ordinal] = class_id
                entries.append(Remembered(frame, ordinal, class_id, cls, blocks, last[class_id] == ordinal, vector, near))
        self.held.append(entries)
        return out


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Between unit vectors, as the search rounds it."""
    return float(np.round(max(1.0 - float(a @ b), 0.0), DISTANCE_DIGITS))


TRACKED = "analysis_id {key}, frame long, ordinal int, class_id int, fresh boolean"


def _scan(objects: DataFrame, new_tracker: Callable[[], Tracker], objects_of: Callable[[pa.RecordBatch], list[tuple]]) -> DataFrame:
    """One ordered scan a recording: rows by frame and ordinal, the tracker's state and one frame at a time."""
    shape = TRACKED.format(key=objects.schema["analysis_id"].dataType.simpleString())
    arrow = to_arrow_schema(T.StructType.fromDDL(shape))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tracker, current = None, None
        for recording, frame, seen in frames_of(batches, objects_of):
            if tracker is None or recording != current:
                tracker, current = new_tracker(), recording
            for hit in tracker.step(frame, seen):
                yield recording, frame, *hit

    rows = objects.where("analysis_id IS NOT NULL AND frame IS NOT NULL").withColumn("frame", F.col("frame").cast("long"))
    return rows.repartition("analysis_id").sortWithinPartitions("analysis_id", "frame", "ordinal").mapInArrow(
        lambda batches: batches_out(ids(batches), arrow), shape)


_SEEN = ["ordinal", "raw_id", "class", "blocks"]


def track(objects: DataFrame, rate: int, n: int = 3, cap: int = 30) -> DataFrame:
    """Ids where the context is this operator's own earlier output (the last n frames).

    Each id depends on the previous frames, so one recording is one ordered scan;
    recordings run in parallel.  Spark sorts the rows by recording and frame and
    the scan holds the tracker's bounded state and one frame, never a recording.
    """
    rows = objects.select("analysis_id", "frame", *_SEEN)
    return _scan(rows, lambda: Tracker(n, rate, cap), lambda batch: lists_of(batch, _SEEN))


def remembered(objects: DataFrame) -> DataFrame:
    """The objects that enter a recording's memory, which their ids do not decide: kept ones with blocks and a vector.

    Kept are new objects and the first of each given number in a frame.
    """
    number = F.regexp_extract("raw_id", r"^(?U)\s*([+-]?[0-9]{1,18})\s*$", 1)
    first = F.row_number().over(Window.partitionBy("analysis_id", "frame", "raw_id").orderBy("ordinal")) == 1
    given = (number != "") & F.when(number != "", number).cast("long").between(-(2**31), 2**31 - 1) & first
    return objects.withColumn("__given", given).where(
        ((F.col("raw_id") == NEW) | F.col("__given")) & (F.size("blocks") > 0) & F.col("embedding").isNotNull()).drop("__given")


def track_similar(objects: DataFrame, rate: int, n: int = 3, k: int = 5, cap: int = 30,
                  tile_rows: int = TILE_ROWS) -> DataFrame:
    """Like ``track``, with the k objects most like the recent ones, of all earlier frames, behind those.

    ``objects`` has an embedding beside the columns of ``track``.  The search over a
    recording's vectors, which is the large part, runs for all detections at once
    (``nearest_earlier``); the scan in order joins its results.
    """
    entries = remembered(objects).select("analysis_id", "frame", "ordinal", "class", "blocks", "embedding")
    asks = entries.select("analysis_id", F.struct("frame", "ordinal").alias("query_id"), (F.col("frame") + 1).alias("frame"),
                          "embedding")
    near = nearest_earlier(asks, entries.withColumn("class_id", F.col("ordinal")), k, tile_rows)
    shapes = entries.select("analysis_id", "frame", F.col("ordinal").alias("class_id"), "class", "blocks")
    lists = near.join(shapes, ["analysis_id", "frame", "class_id"]).groupBy("analysis_id", "query_id").agg(F.array_sort(
        F.collect_list(F.struct("distance", "frame", "class_id", "class", "blocks"))).alias("near")).select(
        "analysis_id", "query_id.frame", "query_id.ordinal", "near")
    rows = objects.select("analysis_id", "frame", "ordinal", "raw_id", "class", "blocks", "embedding").join(
        lists, ["analysis_id", "frame", "ordinal"], "left")

    def objects_of(batch: pa.RecordBatch) -> list[tuple]:
        out = []
        for *seen, look, near in lists_of(batch, [*_SEEN, "embedding", "near"]):
            if near is None:
                out.append((*seen, None, []))
            else:
                out.append((*seen, unit(pd.Series([look]))[0], [
                    (e["distance"], e["frame"], e["class_id"], e["class"], e["blocks"]) for e in near]))
        return out

    # Only what has entries to be compared with needs its vector in the scan.
    rows = rows.withColumn("embedding", F.when(F.col("near").isNotNull(), F.col("embedding")))
    return _scan(rows, lambda: MemoryTracker(n, rate, cap, k), objects_of)


def number_untracked(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Without tracking every object gets the next id of its recording."""
    return number_rows(objects, ["analysis_id"], "frame", ["ordinal"], "class_id", chunk)
