"""Identity assignment over a stream of frames."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.identity import TRACKED, MemoryTracker, Remembered, Tracker
from spanloom.operators.nearest import DISTANCE_DIGITS, unit


SEEN = ["frame", "ordinal", "raw_id", "cls", "blocks"]
SLICE = 10_000  # rows that are Python objects at a time, and of a result


def frames_in_order(batches: Iterable[pd.DataFrame], shape: pa.Schema) -> Iterator[tuple[int, list[tuple]]]:
    """(frame, its rows) of a recording's new rows, by frame and ordinal.

    Spark gives a recording's rows in no order, so those of a batch wait as Arrow columns, with one
    number for a text; as objects there are only those of one slice and one frame.
    """
    parts = [pa.Table.from_arrays([pa.array(part[f.name], f.type, from_pandas=True) for f in shape], schema=shape).unify_dictionaries()
             for part in batches]
    rows = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
    del parts
    order = np.lexsort((rows["ordinal"].to_numpy(), rows["frame"].to_numpy()))
    current, held = None, []
    for begin in range(0, len(order), SLICE):
        piece = rows.take(pa.array(order[begin : begin + SLICE]))
        for row in zip(*[piece[f.name].to_pylist() for f in shape]):
            if row[0] != current:
                if held:
                    yield current, held
                current, held = row[0], []
            held.append(row[1:])
    if held:
        yield current, held


def _shape(objects: DataFrame, names: list[str]) -> pa.Schema:
    """The columns as Arrow holds them while they wait."""
    fields = [pa.field(f.name, f.type) for f in to_arrow_schema(objects.select(*names).schema)]
    return pa.schema([pa.field(f.name, pa.dictionary(pa.int32(), f.type)) if pa.types.is_string(f.type) else f for f in fields])


def _in_parts(recording: object, hits: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while part := list(islice(hits, SLICE)):
        yield pd.DataFrame([(recording, *hit) for hit in part], columns=["analysis_id", "frame", "ordinal", "class_id", "fresh"])


def stream_track(objects: DataFrame, rate: int, n: int = 3, cap: int = 30) -> DataFrame:
    """Ids per recording, continued from batch to batch.

    The state of a recording is its id counter and the objects of the last n
    sampled frames, so it does not grow with the recording, and a frame without
    objects leaves it standing.  Frames must arrive in order.
    """
    key = objects.schema["analysis_id"].dataType.simpleString()

    def advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.exists:
            next_id, recent = state.get
            seen = [(f, [tuple(o) for o in objs]) for f, objs in json.loads(recent)]
            tracker = Tracker(n, rate, cap, next_id, seen)
        else:
            tracker = Tracker(n, rate, cap)
        hits = ((frame, *hit) for frame, seen in frames_in_order(batches, shape) for hit in tracker.step(frame, seen))
        yield from _in_parts(group[0], hits)
        state.update((tracker.next_id, json.dumps(list(tracker.recent))))

    rows = objects.select("analysis_id", "frame", "ordinal", "raw_id", F.col("class").alias("cls"),
                          "blocks").where("analysis_id IS NOT NULL AND frame IS NOT NULL")
    shape = _shape(rows, SEEN)
    return rows.groupBy("analysis_id").applyInPandasWithState(
        advance, TRACKED.format(key=key), "next_id long, recent string", "append",
        GroupStateTimeout.NoTimeout)


class StoredMemory(MemoryTracker):
    """The tracker of a recording between two batches: its whole memory, as the state holds it."""

    def __init__(self, n: int, rate: int, cap: int, k: int, next_id: int, recent: list, entries: list[tuple]) -> None:
        super().__init__(n, rate, cap, k)
        self.next_id, self.recent = next_id, deque(recent)
        self.entries = [Remembered(f, o, i, c, json.loads(b), asks, np.frombuffer(v), []) for f, o, i, c, b, asks, v in entries]
        self.known = len(self.entries)
        self.ids = {(e.frame, e.ordinal): e.class_id for e in self.entries}
        latest = max((e.frame for e in self.entries), default=0)
        by_frame: dict[int, list[Remembered]] = {}
        for e in self.entries:
            if e.frame >= latest - n * rate:
                by_frame.setdefault(e.frame, []).append(e)
        self.held = deque(by_frame[f] for f in sorted(by_frame))
        self.matrix: np.ndarray | None = None

    def nearest(self, asking: Remembered, frame: int) -> list[tuple[float, int, int, str, list[int]]]:
        """The state is queried whole: all entries are of earlier frames, since frames come in order."""
        if self.matrix is None or len(self.matrix) < len(self.entries):
            self.matrix = np.vstack([e.vector for e in self.entries])
        far = np.round(np.maximum(1.0 - self.matrix @ asking.vector, 0.0), DISTANCE_DIGITS)
        cut = np.partition(far, min(self.k, len(far)) - 1)[min(self.k, len(far)) - 1]
        near = [(float(far[j]), e.frame, e.ordinal, e.cls, e.blocks) for j in np.flatnonzero(far <= cut) for e in [self.entries[j]]]
        return sorted(near, key=lambda e: e[:3])[: self.k]

    def step(self, frame: int, objects: list[tuple]) -> list[tuple[int, int, bool]]:
        out = super().step(frame, objects)
        self.entries += self.held[-1]
        return out

    def added(self) -> list[tuple]:
        return [(e.frame, e.ordinal, e.class_id, e.cls, json.dumps(e.blocks), e.asks, e.vector.tobytes())
                for e in self.entries[self.known:]]


class Remembering(StatefulProcessor):
    """A recording's counter and last frames as one value, its memory as a list that only grows at its end."""

    def __init__(self, n: int, rate: int, cap: int, k: int, shape: pa.Schema) -> None:
        self.setting, self.shape = (n, rate, cap, k), shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("tracker", "next_id long, recent string")
        self.memory = handle.getListState(
            "memory", "frame long, ordinal int, class_id int, kind string, blocks string, asks boolean, vector binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        next_id, recent = self.value.get() if self.value.exists() else (1, "[]")
        seen = [(f, [tuple(o) for o in objs]) for f, objs in json.loads(recent)]
        held = [tuple(r) for r in self.memory.get()] if self.memory.exists() else []
        tracker = StoredMemory(*self.setting, next_id, seen, held)

        def hits() -> Iterator[tuple]:
            for frame, seen in frames_in_order(rows, self.shape):
                objects = [(*o, unit(pd.Series([look]))[0] if look is not None and o[3] else None, []) for *o, look in seen]
                for hit in tracker.step(frame, objects):
                    yield frame, *hit

        yield from _in_parts(key[0], hits())
        self.value.update((tracker.next_id, json.dumps(list(tracker.recent))))
        if tracker.added():
            self.memory.appendList(tracker.added())

    def close(self) -> None:
        pass


def stream_track_similar(objects: DataFrame, rate: int, n: int = 3, k: int = 5, cap: int = 30) -> DataFrame:
    """``track_similar`` from batch to batch, its memory in keyed state (RocksDB) that is queried frame by frame.

    A batch of a recording reads its memory once and adds what is new; the memory grows with
    the recording, as the batch operator's table does.  Frames must arrive in order.
    """
    key = objects.schema["analysis_id"].dataType.simpleString()
    rows = objects.select("analysis_id", "frame", "ordinal", "raw_id", F.col("class").alias("cls"), "blocks", "embedding").where(
        "analysis_id IS NOT NULL AND frame IS NOT NULL")
    return rows.groupBy("analysis_id").transformWithStateInPandas(
        Remembering(n, rate, cap, k, _shape(rows, [*SEEN, "embedding"])), TRACKED.format(key=key), "Append", "None")
