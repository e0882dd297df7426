"""Interval construction over streams.

A watermark belongs to the whole stream, so event time must be real time: the start of
the recording plus the frame's time in it (``event_time``).  A recording that begins
after another has gone on is then not late.  How late rows may come is stated by the
caller; rows later than that are dropped, as in any stream, and so are rows at or before the
epoch, where a watermark begins.  An interval appears once its
own recording, or the whole stream, has gone on beyond it (``closing.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.streaming.closing import closed_intervals

MICROS = 1_000_000


def frame_micros(fps: int | Column) -> Column:
    """Whole microseconds of a frame, so that multiples of it are exact."""
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    return F.floor(F.lit(MICROS) / rate).cast("long")


def event_time(started: Column, frame: Column, fps: int | Column) -> Column:
    return F.timestamp_micros(F.unix_micros(started.cast("timestamp")) + frame.cast("long") * frame_micros(fps))


def bucket_of(frame: Column, width: int) -> Column:
    return F.floor(frame / F.lit(width)).cast("long")


def stream_intervals(observed: DataFrame, sampling_rate: int | Column, keys: Sequence[str], *,
                     started: Column, fps: int | Column, lateness: str) -> DataFrame:
    """Collapse streamed frames; a gap over two sampling steps ends an interval.

    ``sampling_rate`` and ``fps`` may be columns, so every recording has its own.
    """
    rate = sampling_rate if isinstance(sampling_rate, Column) else F.lit(sampling_rate)
    timed = observed.withColumn("__ts", event_time(started, F.col("frame"), fps))
    frame = F.col("frame")
    return closed_intervals(timed, keys, "__ts", frame, frame, 2 * rate, 2 * rate * frame_micros(fps), F.lit(None),
                            lateness).select(*keys, F.col("first").alias("start_frame"), F.col("last").alias("end_frame"))


def stream_coalesce_audio(predictions: DataFrame, hop_frames: int | Column,
                          keys: Sequence[str] = ("analysis_id", "audio_class"), *,
                          started: Column, fps: int | Column, lateness: str) -> DataFrame:
    """Merge streamed windows: one joins another that ends at most a hop before it starts."""
    if not isinstance(hop_frames, Column) and hop_frames < 1:
        raise ValueError("a session needs a hop of at least one frame")
    hop = hop_frames if isinstance(hop_frames, Column) else F.lit(hop_frames)
    timed = predictions.withColumn("__ts", event_time(started, F.col("start_frame"), fps))
    start, end = F.col("start_frame"), F.col("end_frame")
    return closed_intervals(timed, keys, "__ts", start, end, hop, (end - start + hop) * frame_micros(fps), F.col("confidence"),
                            lateness).select(*keys, F.col("first").alias("start_frame"), F.col("last").alias("end_frame"),
                                             "confidence")


def stream_before(left: DataFrame, right: DataFrame, delta: int, *, left_started: Column, right_started: Column,
                  fps: int, lateness: str, key: str = "analysis_id", rho: int = 0, strict: bool = False) -> DataFrame:
    """Bounded Bef between two streams.

    ``left`` holds key, r_sf, r_ef and ``right`` holds key, s_sf, s_ef (other
    columns ride along).  Because s_sf lies in [r_ef - rho, r_ef + delta + rho],
    the watermarks let Spark drop rows that can no longer match.  A time bucket is part of the
    key, as in the batch join: a left row lies in one, a right row in the one or two it can be met
    from, so a row reads few others from the state and a long recording spreads over the tasks.
    """
    step = MICROS // fps
    r = left.withColumn("__r", event_time(left_started, F.col("r_ef"), fps)).withWatermark("__r", lateness)
    s = right.withColumn("__s", event_time(right_started, F.col("s_sf"), fps)).withColumnRenamed(
        key, "__key").withWatermark("__s", lateness)
    # Eight reaches wide, so that few right rows are copied.
    width = 8 * (delta + 2 * rho + 1)
    r = r.withColumn("__r_bucket", bucket_of(F.col("r_ef"), width))
    s = s.withColumn("__s_bucket", F.explode(F.sequence(
        bucket_of(F.col("s_sf") - delta - rho, width), bucket_of(F.col("s_sf") + rho, width))))
    gap = F.col("s_sf") - F.col("r_ef")
    opening = F.col("r_ef") < F.col("s_sf") + rho if strict else F.col("r_ef") <= F.col("s_sf") + rho

    def span(frames: int) -> Column:
        return F.expr(f"make_dt_interval(0, 0, 0, {frames * step / MICROS:.6f})")

    condition = (
        (F.col(key) == F.col("__key")) & (F.col("__r_bucket") == F.col("__s_bucket")) & opening & (gap <= delta + rho)
        & (F.col("__s") >= F.col("__r") - span(rho)) & (F.col("__s") <= F.col("__r") + span(delta + rho)))
    return r.join(s, condition).drop("__r", "__s", "__key", "__r_bucket", "__s_bucket")
