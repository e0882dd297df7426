"""Comparing predicted intervals with ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.time import overlap_length
from spanloom.operators.prefix import CHUNK, chunk_of, prefix_max
from spanloom.operators.range_join import overlap_join


def best_overlap(truth: DataFrame, predictions: DataFrame, keys: Sequence[str],
                 truth_id: str) -> DataFrame:
    """Each truth row with the touching prediction of largest overlap, if any.

    Both sides hold ``keys``, class, sf, ef.  Ties go to the earlier start, then
    the smaller end and class.
    """
    preds = predictions.select(*[F.col(k).alias("p_" + k) for k in keys],
                               F.col("class").alias("pred_class"), F.col("sf").alias("pred_sf"),
                               F.col("ef").alias("pred_ef"))
    # Copies of a prediction cannot change the best one.
    touching = overlap_join(truth, preds.distinct(), [(k, "p_" + k) for k in keys],
                            ("sf", "ef"), ("pred_sf", "pred_ef"))
    length = overlap_length(F.col("sf"), F.col("ef"), F.col("pred_sf"), F.col("pred_ef"))
    ranked = F.struct((-length).alias("o"), "pred_sf", "pred_ef", "pred_class")
    best = touching.groupBy(truth_id).agg(F.min(ranked).alias("b"))
    return truth.join(best, truth_id, "left").select(
        *truth.columns, F.col("b.pred_class").alias("pred_class"),
        F.col("b.pred_sf").alias("pred_sf"), F.col("b.pred_ef").alias("pred_ef"),
        F.coalesce(-F.col("b.o"), F.lit(0)).alias("overlap"))


def capture_table(truth: DataFrame, predictions: DataFrame, keys: Sequence[str],
                  truth_id: str) -> DataFrame:
    return best_overlap(truth, predictions, keys, truth_id).withColumn(
        "correct", F.coalesce(F.col("pred_class") == F.col("class"), F.lit(False)))


def touches(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``touched``: whether any of ``others`` with equal keys meets the interval.

    One does exactly if the furthest end among those that start by the row's end
    reaches the row's start: a running maximum along the time line, so no pair is
    ever formed.  Equal intervals and equal starts fold beforehand.
    """
    spans = rows.select(*keys, "sf", "ef").distinct()
    ends = others.groupBy(*keys, "sf").agg(F.max("ef").alias("reach"))
    no_end = F.lit(None).cast(ends.schema["reach"].dataType)
    line = ends.select(*keys, F.col("sf").alias("pos"), F.lit(0).alias("side"), "sf", "reach").union(
        spans.select(*keys, F.col("ef").alias("pos"), F.lit(1).alias("side"), "sf", no_end))
    reached = prefix_max(line, keys, "pos", "reach", "furthest", ties=["side", "sf"], inclusive=True)
    flags = reached.where("side = 1").select(
        *keys, "sf", F.col("pos").alias("ef"),
        F.coalesce(F.col("furthest") >= F.col("sf"), F.lit(False)).alias("touched"))
    return rows.join(flags, [*keys, "sf", "ef"], "left").withColumn(
        "touched", F.coalesce("touched", F.lit(False)))


def class_outcomes(truth: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TP, FN and FP rows by same-class overlap: keys, class, result.

    Truth against predictions and predictions against truth run as two groups of
    one pass.
    """
    same = [*keys, "class", "sf", "ef"]

    def both(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.select(*same, F.lit("truth").alias("__from")).union(
            second.select(*same, F.lit("prediction")))

    flags = touches(both(truth, predictions), both(predictions, truth), [*keys, "class", "__from"])
    found = F.when(F.col("touched"), "TP").otherwise("FN")
    result = F.when(F.col("__from") == "truth", found).otherwise(F.when(~F.col("touched"), "FP"))
    return flags.select(*keys, "class", result.alias("result")).where("result IS NOT NULL")


def flag_detected(expected: DataFrame, detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected rows with ``detected``, true where a detection exists."""
    found = detections.select(*keys).distinct().withColumn("detected", F.lit(True))
    return expected.join(found, list(keys), "left").withColumn(
        "detected", F.coalesce("detected", F.lit(False)))


def negative_pairs(scenes: DataFrame, expected: DataFrame, events: Sequence[str],
                   keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Every (scene, event) that is not expected; the event names are a short literal list."""
    every = scenes.select(*keys).distinct().withColumn(
        "event", F.explode(F.array(*[F.lit(e) for e in events])))
    return every.join(expected.select(*keys, "event").distinct(), [*keys, "event"], "left_anti")


def event_outcomes(scenes: DataFrame, expected: DataFrame, detections: DataFrame,
                   events: Sequence[str], keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(scene, event, detected, result) with TP/FN for expected and FP for other pairs.

    ``keys`` may hold more than the scene, such as a condition or a configuration.  One
    aggregate over all three inputs: a join would let Spark send a side to every executor by
    the size of its file, which says nothing of a side that an explode has made.
    """
    pair = [*keys, "event"]
    wanted, found, ran = 1, 2, 4

    def flagged(rows: DataFrame, flag: int) -> DataFrame:
        return rows.select(*pair, F.lit(flag).alias("__flag"))

    every = scenes.select(*keys, F.explode(F.array(*[F.lit(e) for e in events])).alias("event"))
    # Null is equal to nothing: only an expected row may hold it.
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in pair)
    tagged = flagged(expected, wanted).union(flagged(detections.where(whole), found)).union(flagged(every.where(whole), ran))
    pairs = tagged.groupBy(*pair).agg(F.bit_or("__flag").alias("__flag"))

    def has(flag: int) -> Column:
        return F.col("__flag").bitwiseAND(flag) > 0

    result = F.when(has(wanted) & has(found), "TP").when(has(wanted), "FN").when(has(found) & has(ran), "FP")
    return pairs.select(*pair, has(found).alias("detected"), result.alias("result")).where("result IS NOT NULL")


def evidence(intervals: DataFrame, keys: Sequence[str], label: Column, out: str,
             part_frames: int = CHUNK) -> DataFrame:
    """``label(start-end), ...`` by start, distinct intervals only: keys, part, text.

    The text comes in parts of ``part_frames`` of start time, so a long recording
    never becomes one value in one task; its parts in order are the whole text.
    """
    item = F.struct("sf", "ef", label.alias("label"))
    texts = F.transform(F.array_sort(F.collect_set(item)), lambda i: F.concat(
        i["label"], F.lit("("), i["sf"].cast("string"), F.lit("-"), i["ef"].cast("string"), F.lit(")")))
    return intervals.groupBy(*keys, chunk_of(F.col("sf"), part_frames).alias("part")).agg(
        F.array_join(texts, ", ").alias(out))
