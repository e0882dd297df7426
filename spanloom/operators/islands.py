"""Building intervals: merging rows of one key that lie close together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spanloom.operators.spread import spread

# Cells (of gap + 1 frames) per chunk; bounds the rows any one task sorts for a key.
CELLS_PER_CHUNK = 1 << 14
_WINDOW_BLOCK = 4096


def merge_close(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: int | str,
                maxima: Sequence[str] = (), cells_per_chunk: int | None = CELLS_PER_CHUNK) -> DataFrame:
    """Merge a row into its predecessors when ``start <= their largest end + gap``.

    Result: keys, start, end and the maximum of each extra column.  Exact for any
    skew, in three reductions:

    1. Starts inside one cell of ``gap + 1`` frames always belong together, so a
       partial aggregate folds them (copies too) before the first shuffle.
    2. Chunks of cells are merged independently, at most ``cells_per_chunk``
       rows each, and one summary row per chunk says what reaches into the next.
    3. Pieces of an interval that crosses chunks are joined by one aggregate.

    ``gap`` may name a column that is constant within a key, such as a recording's
    own gap; it becomes one of the keys.  ``cells_per_chunk=None`` scans each key whole, which saves two shuffles when
    every key is known to be short.
    """
    if isinstance(gap, str):
        keys, gap = list(dict.fromkeys([*keys, gap])), F.col(gap)
    elif gap < 0:
        raise ValueError("gap must not be negative")
    width = gap if isinstance(gap, Column) else F.lit(gap)
    # Whole numbers of one cell lie at most ``gap`` apart; real ones need a cell that narrow, or their own.
    if isinstance(rows.schema[start].dataType, T.IntegralType):
        cell = F.floor(F.col(start) / F.lit(width + 1)).cast("long")
    else:
        cell = F.when(width > 0, F.floor(F.col(start) / F.nullif(width, F.lit(0)))).otherwise(F.col(start)).cast("double")
    folded = rows.groupBy(*keys, cell.alias("__cell")).agg(
        F.min(start).alias("__s"), F.max(end).alias("__e"), *[F.max(m).alias(m) for m in maxima],
    )
    if cells_per_chunk is None:
        return _pieces(folded, keys, gap, maxima).withColumnsRenamed({"__piece": start, "__e": end})
    folded = folded.withColumn("__chunk", F.floor(F.col("__cell") / F.lit(cells_per_chunk)).cast("long"))
    # A number for each chunk, never null, by which its rows are placed once: scan and join then share that place.
    # Scanned, folded and joined in one task each: sorted rows, pieces and summaries at a time, so many small tasks.
    folded = spread(folded.withColumn("__place", F.xxhash64(*keys, "__chunk")), "__place")
    pieces = _pieces(folded, ["__place", *keys, "__chunk"], gap, maxima)

    # Per chunk: how far earlier chunks reach, and where the interval open at the
    # chunk's edge began.  A chunk's last piece opens a new interval unless it is
    # itself within reach.
    before = (Window.partitionBy(*keys).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    summary = pieces.groupBy("__place", *keys, "__chunk").agg(
        F.max("__e").alias("__reach"), F.max("__piece").alias("__last"), *[F.max(m).alias("__most_" + m) for m in maxima],
    ).withColumn("__carry_end", F.max("__reach").over(before)).withColumn(
        "__opened", F.when(F.col("__carry_end").isNull()
                           | (F.col("__last") > F.col("__carry_end") + gap), F.col("__last")),
    ).withColumn("__carry_start", F.last("__opened", ignorenulls=True).over(before)).select(
        F.col("__place").alias("__k_place"), *[F.col(k).alias("__k_" + k) for k in keys], F.col("__chunk").alias("__k_chunk"),
        "__carry_end", "__carry_start", *["__most_" + m for m in maxima])

    # Chunks of one number are told apart by counting the keys that differ, null-safe: comparisons of single keys would
    # be taken for join keys, by which Spark places the pieces anew.  A column that only one branch reads would stop it
    # from reusing the shuffled chunks for both, hence the maxima in both, under a condition that is always true.
    differ = [(~F.col(k).eqNullSafe(F.col(o))).cast("int") for k, o in
              [*[(k, "__k_" + k) for k in keys], ("__chunk", "__k_chunk")]]
    same = (F.col("__place") == F.col("__k_place")) & (reduce(add, differ) == 0)
    for m in maxima:
        same = same & F.coalesce(F.col(m) <= F.col("__most_" + m), F.lit(True))
    continued = F.col("__piece") <= F.col("__carry_end") + gap
    joined = pieces.join(summary, same).select(
        *keys, F.when(continued, F.col("__carry_start")).otherwise(F.col("__piece")).alias(start),
        "__e", *maxima)
    return joined.groupBy(*keys, start).agg(
        F.max("__e").alias(end), *[F.max(m).alias(m) for m in maxima])


def _pieces(folded: DataFrame, keys: Sequence[str], gap: int | Column, maxima: Sequence[str]) -> DataFrame:
    """Merged rows per key by one ordered scan: ``__piece`` (start) and ``__e`` (end)."""
    inside = Window.partitionBy(*keys).orderBy("__s")
    reach = F.max("__e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("__s") > reach + gap), F.col("__s"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return folded.withColumn("__piece", opened).withColumn(
        "__piece", F.last("__piece", ignorenulls=True).over(so_far)
    ).groupBy(*keys, "__piece").agg(F.max("__e").alias("__e"), *[F.max(m).alias(m) for m in maxima])


def participant_sets(relations: DataFrame) -> DataFrame:
    """One row per relation in a frame, with its participants as a sorted array."""
    return relations.groupBy("analysis_id", "frame", "relation_id", "relation_type").agg(
        F.array_sort(F.collect_set("class_id")).alias("participants"))


def frames_to_intervals(observed: DataFrame, sampling_rate: int | str,
                        keys: Sequence[str] = ("analysis_id", "relation_type", "participants"),
                        **options) -> DataFrame:
    """Collapse observed frames; a gap over two sampling steps starts a new interval.

    ``sampling_rate`` may name a column: every recording then has its own.
    """
    points = [F.col("frame").alias("start_frame"), F.col("frame").alias("end_frame")]
    if isinstance(sampling_rate, str):
        timed = observed.select(*keys, *points, (2 * F.col(sampling_rate)).alias("__gap"))
        return merge_close(timed, keys, "start_frame", "end_frame", "__gap", **options).drop("__gap")
    points = observed.select(*keys, *points)
    return merge_close(points, keys, "start_frame", "end_frame", 2 * sampling_rate, **options)


def coalesce_audio(predictions: DataFrame, hop_frames: int | str,
                   keys: Sequence[str] = ("analysis_id", "audio_class"), **options) -> DataFrame:
    """Merge classified windows of one class, keeping the best confidence.

    ``hop_frames`` may name a column: every recording then has its own.
    """
    merged = merge_close(predictions, keys, "start_frame", "end_frame", hop_frames,
                         maxima=["confidence"], **options)
    return merged.select(*keys, "start_frame", "end_frame", "confidence")


def gap_to_previous(rows: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Distance to the previous row of the key, NULL for the first.

    ``order`` is unique within the key; chunked like the other running values.
    """
    from spanloom.operators.prefix import prefix_max

    return prefix_max(rows, keys, order, order, "__previous").withColumn(
        out, F.col(order) - F.col("__previous")).drop("__previous")


def running_end(rows: DataFrame, keys: Sequence[str], order: str, end: str, out: str) -> DataFrame:
    """Largest end among the key's earlier rows."""
    from spanloom.operators.prefix import prefix_max

    return prefix_max(rows, keys, order, end, out)


def class_map(per_frame: DataFrame) -> DataFrame:
    """Each object's class: the one seen in its latest frame, then the larger name."""
    return per_frame.groupBy("analysis_id", "class_id").agg(
        F.max_by("class", F.struct("frame", "class")).alias("class"))


def analysis_windows(recordings: DataFrame, samples: Column, sample_rate: int, fps: Column,
                     window_seconds: float, hop_seconds: float, limit: int | None = None) -> DataFrame:
    """Sliding windows that fit into each recording, in samples and in frames.

    A recording shorter than the window gets one short window; windows under
    half a second are dropped.
    """
    win, hop = int(window_seconds * sample_rate), int(hop_seconds * sample_rate)
    last = F.floor(F.greatest(samples - win, F.lit(0)) / hop)
    if limit is not None:
        last = F.least(last, F.lit(limit - 1))
    # Two explodes keep the arrays short for a recording of any length.
    block = recordings.withColumn("__last", last.cast("long")).withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / _WINDOW_BLOCK))))
    index = F.explode(F.sequence(F.col("__block") * _WINDOW_BLOCK, F.least(
        F.col("__last"), (F.col("__block") + 1) * _WINDOW_BLOCK - 1)))
    out = block.withColumn("window_start", index).withColumn(
        "window_start", F.col("window_start") * hop).withColumn(
        "window_end", F.least(F.col("window_start") + win, samples.cast("long"))).drop("__last", "__block")
    kept = out.where(F.col("window_end") - F.col("window_start") >= sample_rate // 2)
    return kept.withColumn(
        "start_frame", (F.col("window_start") / sample_rate * fps).cast("long")
    ).withColumn("end_frame", (F.col("window_end") / sample_rate * fps).cast("long"))


def assign_windows(samples: DataFrame, position: str, window: int, hop: int) -> DataFrame:
    """Attach every sliding window (multiples of hop) that contains the sample."""
    first = F.floor((F.col(position) - window) / hop) + 1
    last = F.floor(F.col(position) / hop)
    starts = F.transform(F.sequence(F.greatest(first, F.lit(0)), last), lambda i: i * hop)
    return samples.withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.col("window_start") + window)


def top_label(scores: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score",
              floor: float | None = None) -> DataFrame:
    """The best-scored label per window; equal scores go to the smaller label."""
    best = F.min_by(F.struct(label, score), F.struct((-F.col(score)).alias("s"), label))
    out = scores.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")
    return out if floor is None else out.where(F.col(score) >= floor)
