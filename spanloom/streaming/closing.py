"""Intervals of a stream, closed by their recording's own progress.

A recording's state is its open intervals and how far it has come.  A row may come
``lateness`` behind that; what reaches less far can grow no more, is given out once, and
leaves the state.  A recording that falls silent is closed by a timer, when the watermark
of the whole stream has passed its last row and gap, and leaves no state at all.  So the state
is what is open now, however long the stream runs, and output is append only.

Recordings share ``BUCKETS`` keys by a hash, so the calls and pandas steps that a key costs in a batch are paid once a
bucket, not once a recording.  A recording's progress is stored beside its open intervals; one is always open, that of
its latest row.

Rows later than stated are dropped, by their own recording's progress and by the stream's
watermark, as in any stream.  The event time reaches Python as whole microseconds only: as a
timestamp, pandas could hold none after the year 2262.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A join keeps one store a partition instead of four, and a batch saves its changes instead of all files.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.join.stateFormatVersion": "3",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
# Keys that recordings are dealt to; part of a running stream's state, as is the layout of OPEN_TYPE.
BUCKETS = 1024
OPEN = ["label", "first", "last", "reach", "until", "confidence"]
FOLD_ROWS, OUT_ROWS = 100_000, 10_000
OPEN_TYPE = "label string, first long, last long, reach long, until long, confidence double, reached long"
EVER = np.iinfo(np.int64).min


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; queries take the settings when they start."""
    for key, value in STATE.items():
        spark.conf.set(key, value)


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one label that reach each other as one; ``reach`` is the last start that still joins, ``until`` its time."""
    rows = rows.sort_values(["label", "first"], kind="stable")
    before = rows.groupby("label")["reach"].cummax().groupby(rows["label"]).shift()
    island = (before.isna() | (rows["first"] > before)).cumsum()
    return rows.groupby(island).agg(label=("label", "first"), first=("first", "min"), last=("last", "max"),
                                    reach=("reach", "max"), until=("until", "max"), confidence=("confidence", "max"))


class Gathered:
    """A recording's intervals while its rows come, with a number for each label.

    What has come is folded whenever it outgrows what is held, so rows wait no longer than that.
    """

    def __init__(self) -> None:
        self.labels: dict[str, int] = {}
        self.held: pd.DataFrame | None = None
        self.new: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, rows: pd.DataFrame) -> None:
        numbers = [self.labels.setdefault(label, len(self.labels)) for label in rows["label"]]
        rows = rows[OPEN].assign(label=np.array(numbers, "int32"))
        self.new.append(rows.astype({c: "int64" for c in OPEN[1:5]} | {"confidence": "float64"}))
        self.waiting += len(rows)
        if self.waiting >= max(FOLD_ROWS, 0 if self.held is None else len(self.held)):
            self.fold()

    def fold(self) -> pd.DataFrame:
        if self.new:
            self.held = merged(pd.concat([*([] if self.held is None else [self.held]), *self.new]))
            self.new, self.waiting = [], 0
        return self.held

    def named(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The rows in bounded pieces, their labels written out."""
        names = list(self.labels)
        for begin in range(0, len(rows), OUT_ROWS):
            part = rows.iloc[begin : begin + OUT_ROWS]
            yield part.assign(label=[names[i] for i in part["label"]])


class Progress:
    """How far each recording of a bucket had come before the batch, and has come with it."""

    def __init__(self, lateness: int) -> None:
        self.lateness = lateness
        self.numbers: dict = {}
        self.floor, self.reached = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, recordings: Sequence) -> np.ndarray:
        numbers = np.array([self.numbers.setdefault(r, len(self.numbers)) for r in recordings], np.int64)
        fresh = np.full(len(self.numbers) - len(self.floor), EVER)
        self.floor, self.reached = np.append(self.floor, fresh), np.append(self.reached, fresh)
        return numbers

    def stored(self, recordings: Sequence, reached: np.ndarray) -> None:
        numbers = self.of(recordings)
        self.reached[numbers], self.floor[numbers] = reached, reached - self.lateness

    def in_time(self, recordings: Sequence, at: np.ndarray) -> np.ndarray:
        """Which rows are not later than stated, by what was stored."""
        numbers = self.of(recordings)
        kept = at >= self.floor[numbers]
        np.maximum.at(self.reached, numbers[kept], at[kept])
        return kept


def latest(rows: pd.DataFrame) -> pd.Series:
    """Of each row's recording, milliseconds after the latest time at which a row could still join."""
    return rows.groupby("recording")["until"].transform("max") // 1000 + 1


class Closing(StatefulProcessor):
    def __init__(self, lateness: int, kind: str) -> None:  # microseconds; type of the recordings
        self.lateness, self.kind = lateness, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "timer long")
        self.open = handle.getListState("open", f"recording {self.kind}, {OPEN_TYPE}")

    def held(self) -> Iterator[pd.DataFrame]:
        entries = iter(self.open.get()) if self.open.exists() else iter(())
        while part := [tuple(r) for r in islice(entries, OUT_ROWS)]:
            yield pd.DataFrame(part, columns=["recording", *OPEN, "reached"])

    def keep(self, rows: pd.DataFrame) -> None:
        """``rows`` in the state, after it was cleared."""
        rows = rows[["recording", *OPEN, "reached"]].astype(object)
        for begin in range(0, len(rows), OUT_ROWS):
            part = rows.iloc[begin : begin + OUT_ROWS]
            self.open.appendList(list(part.where(part.notna(), None).itertuples(index=False, name=None)))

    def wake(self, due: int | None, now: int | None) -> None:
        """One timer a bucket, when the first of its recordings can be closed."""
        if due == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def given_out(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["recording", "label", "first", "last", "confidence"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        progress, gathered, some = Progress(self.lateness), Gathered(), False
        for part in self.held():
            progress.stored(part["recording"].tolist(), part["reached"].to_numpy(np.int64))
            gathered.add(part.assign(label=list(zip(part["recording"].tolist(), part["label"], strict=True))))
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        for come in rows:
            # Where the stream has left a time behind, its recordings may be closed already.
            come = come[come["at"] > watermark]
            come = come[progress.in_time(come["recording"].tolist(), come["at"].to_numpy(np.int64))]
            if come.empty:
                continue
            some = True
            gathered.add(come.assign(label=list(zip(come["recording"].tolist(), come["label"], strict=True))))
        if not some:
            return
        both, names = gathered.fold(), list(gathered.labels)
        both = both.assign(recording=[names[i][0] for i in both["label"]])
        both["reached"] = progress.reached[progress.of(both["recording"].tolist())]
        both["label"] = [names[i][1] for i in both["label"]]
        done = both["until"] < both["reached"] - self.lateness
        still = both[~done]
        self.open.clear()
        self.keep(still)
        self.wake(int(latest(still).min()), self.timer.get()[0] if self.timer.exists() else None)
        gone = both[done]
        for begin in range(0, len(gone), OUT_ROWS):
            yield self.given_out(gone.iloc[begin : begin + OUT_ROWS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left, past = list(self.held()), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.open.clear()
        self.timer.clear()
        if not left:
            return
        left = pd.concat(left)
        due = latest(left)
        self.keep(left[due > past])
        if (due > past).any():
            self.wake(int(due[due > past].min()), None)
        gone = left[due <= past]
        for begin in range(0, len(gone), OUT_ROWS):
            yield self.given_out(gone.iloc[begin : begin + OUT_ROWS])

    def close(self) -> None:
        pass


def closed_intervals(rows: DataFrame, keys: Sequence[str], time: str, first: Column, last: Column, gap: Column,
                     gap_micros: Column, confidence: Column, lateness: str) -> DataFrame:
    """``keys``, first, last, confidence of intervals that are complete.

    ``time`` is the event time of ``first``, and ``gap_micros`` the time from there to the
    last start that still joins, which is ``last`` + ``gap``; ``keys`` begin with the recording.
    """
    recording, labels = keys[0], list(keys[1:])
    kind = rows.schema[recording].dataType.simpleString()
    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in labels)
    late = rows.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{lateness}') AS us").first()["us"]
    at = F.unix_micros(time)
    made = rows.withWatermark(time, lateness).where(F.col(recording).isNotNull() & first.isNotNull()).select(
        F.pmod(F.xxhash64(recording), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(recording).alias("recording"), F.to_json(F.struct(*labels)).alias("label"), first.cast("long").alias("first"),
        last.cast("long").alias("last"), (last + gap).cast("long").alias("reach"), (at + gap_micros).cast("long").alias("until"),
        confidence.cast("double").alias("confidence"), at.alias("at"))
    closed = made.groupBy("bucket").transformWithStateInPandas(
        Closing(late, kind), f"recording {kind}, label string, first long, last long, confidence double", "Append", "EventTime")
    return closed.select(F.col("recording").alias(recording), F.from_json("label", shape).alias("l"), "first", "last",
                         "confidence").select(recording, "l.*", "first", "last", "confidence")
