"""Sweeps over analysis windows and over producers, each as one job.

All window lengths and hops are multiples of one step.  Scores are folded into panes of that
step once; a window of any configuration is a run of panes, so every configuration reads
the panes, a row for each label and pane, and none reads the scores again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.islands import coalesce_audio, top_label

CONFIG = ("window", "hop")


def pane_step(grid: Sequence[tuple[int, int]]) -> int:
    if not grid or min(min(c) for c in grid) < 1:
        raise ValueError("a sweep needs windows and hops of at least one step")
    return reduce(gcd, [x for config in grid for x in config])


def panes(scores: DataFrame, position: str, step: int, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """The best score of each label in each pane; folds before the shuffle."""
    return scores.where(F.col(position).isNotNull()).groupBy(
        *keys, label, F.floor(F.col(position) / step).cast("long").alias("pane")).agg(F.max(score).alias(score))


def window_labels(scores: DataFrame, position: str, grid: Sequence[tuple[int, int]], keys: Sequence[str],
                  label: str = "label", score: str = "score", floor: float | None = None) -> DataFrame:
    """window, hop, keys, start_frame, end_frame, label, score: the best label of every window of every configuration.

    Windows start at 0 and the multiples of their hop; equal scores go to the smaller label.
    """
    step = pane_step(grid)
    configs = F.array(*[F.struct(F.lit(w).cast("long").alias("window"), F.lit(h).cast("long").alias("hop")) for w, h in grid])
    held = panes(scores, position, step, keys, label, score)
    each = held.withColumn("c", F.explode(configs)).select(*keys, label, score, "pane", "c.*")
    at = F.col("pane") * step
    first = F.greatest(F.floor((at - F.col("window")) / F.col("hop")) + 1, F.lit(0))
    starts = F.transform(F.sequence(first, F.greatest(F.floor(at / F.col("hop")), first)), lambda i: i * F.col("hop"))
    placed = each.withColumn("start_frame", F.explode(F.filter(
        starts, lambda s: (s <= at) & (s + F.col("window") >= at + step))))
    best = top_label(placed, [*CONFIG, *keys, "start_frame"], label, score, floor)
    return best.withColumn("end_frame", F.col("start_frame") + F.col("window"))


def sweep_intervals(scores: DataFrame, position: str, grid: Sequence[tuple[int, int]], keys: Sequence[str],
                    label: str = "label", score: str = "score", floor: float | None = None) -> DataFrame:
    """The windows of each configuration as intervals of one class, by its own hop."""
    rows = window_labels(scores, position, grid, keys, label, score, floor).withColumnsRenamed(
        {label: "audio_class", score: "confidence"})
    return coalesce_audio(rows.select(*CONFIG, *keys, "audio_class", "start_frame", "end_frame", "confidence"), "hop",
                          [*CONFIG, *keys, "audio_class"])


def producer_pairs(seen: DataFrame, heard: DataFrame, scenes: DataFrame) -> DataFrame:
    """What each pair of a visual and an audio producer detects: an event counts if either of them has it.

    ``seen`` and ``heard``: producer, scene, event.  ``scenes``: visual, audio, scene, one
    row for each pair and scene it ran on.  A producer's detections meet the pairs it is in.
    """
    # By a sort, since a plan takes pairs that an explode has made for as small as the scenes' file.
    parts = [found.select(F.col("producer").alias(side), "scene", "event").distinct().join(scenes.hint("merge"), [side, "scene"])
             for side, found in (("visual", seen), ("audio", heard))]
    columns = ["visual", "audio", "scene", "event"]
    return parts[0].select(columns).union(parts[1].select(columns)).distinct()
