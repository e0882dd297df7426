"""Nearest vectors among earlier frames of the same recording, and the context of tracked objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from spanloom.operators.nearest import TILE_ROWS, nearest_earlier


def recent_objects(objects: DataFrame, sampled: DataFrame, rate: int, n: int) -> DataFrame:
    """Objects of the last n sampled frames before each sampled frame, once per object.

    A frame without objects still takes up one of the n places.  An object of
    sampled frame i serves the frames i+1 .. i+n, so the lookup is an equi-join;
    ``origin`` is the earliest of those frames it was seen in.
    """
    ahead = objects.withColumn("origin", F.col("frame")).withColumn(
        "frame", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)),
                                       lambda i: F.col("frame") + i * rate)))
    once = ahead.groupBy("analysis_id", "frame", "class_id").agg(
        F.min(F.struct("origin", *[c for c in objects.columns
                                   if c not in ("analysis_id", "frame", "class_id")])).alias("o"))
    # By sorting: the size of the files says little about how many frames there are.
    targets = sampled.select("analysis_id", "frame").distinct().hint("merge")
    return once.join(targets, ["analysis_id", "frame"], "left_semi").select(
        "analysis_id", "frame", "class_id", "o.*")


def similar_objects(objects: DataFrame, sampled: DataFrame, rate: int, n: int, k: int,
                    tile_rows: int = TILE_ROWS) -> DataFrame:
    """The k objects most similar to what the last n sampled frames showed.

    Each vector of those frames fetches its k nearest earlier entries, an object
    keeps its best entry over all of them, and the k nearest objects remain.
    """
    targets = sampled.select("analysis_id", "frame").distinct().hint("merge")
    asks = objects.withColumn("seen_frame", F.col("frame")).withColumn(
        "frame", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)),
                                       lambda i: F.col("frame") + i * rate))
    ).join(targets, ["analysis_id", "frame"], "left_semi").select(
        "analysis_id", F.struct("frame", "seen_frame", "class_id").alias("query_id"), "frame",
        "embedding")
    entries = objects.select("analysis_id", "frame", "class_id", "embedding")
    near = nearest_earlier(asks, entries, k, tile_rows)
    best = near.groupBy("analysis_id", F.col("query_frame").alias("target_frame"), "class_id").agg(
        F.min(F.struct("distance", "frame")).alias("b"))
    order = Window.partitionBy("analysis_id", "target_frame").orderBy("b.distance", "class_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(
        "analysis_id", F.col("target_frame").alias("frame"), "class_id",
        F.col("b.frame").alias("origin"), F.col("b.distance").alias("distance"), "place")


def tracking_context(recent: DataFrame, similar: DataFrame, keep: Sequence[str] = (),
                     cap: int = 30) -> DataFrame:
    """Recent objects, then similar ones not among them, at most ``cap`` per frame.

    The cap is part of the operator: it bounds what one frame is compared with.
    """
    first = recent.select("analysis_id", "frame", "class_id", "origin", F.lit(0).alias("source"),
                          F.col("origin").cast("double").alias("__rank"), *keep)
    second = similar.select("analysis_id", "frame", "class_id", "origin", F.lit(1).alias("source"),
                            F.col("distance").alias("__rank"), *keep)
    rest = [c for c in first.columns if c not in ("analysis_id", "frame", "class_id")]
    ordered = ["source", "__rank", *[c for c in rest if c not in ("source", "__rank")]]
    merged = first.unionByName(second).groupBy("analysis_id", "frame", "class_id").agg(
        F.min(F.struct(*ordered)).alias("c"))
    order = Window.partitionBy("analysis_id", "frame").orderBy("c.source", "c.__rank", "class_id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(
        "analysis_id", "frame", "class_id", "c.*", "place").drop("__rank")


def memory_stats(entries: DataFrame) -> DataFrame:
    """Per recording: number of entries, first and last frame, entries per class."""
    per_class = entries.groupBy("analysis_id", "class").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    return per_class.groupBy("analysis_id").agg(
        F.sum("n").alias("total"), F.min("lo").alias("frame_min"), F.max("hi").alias("frame_max"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("per_class"))


def list_entries(entries: DataFrame, class_name: str | None = None, frame_min: int | None = None,
                 frame_max: int | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """One page of the stored entries in (analysis, frame, object) order, with the full total."""
    rows = entries
    if class_name is not None:
        rows = rows.where(F.col("class") == class_name)
    if frame_min is not None:
        rows = rows.where(F.col("frame") >= frame_min)
    if frame_max is not None:
        rows = rows.where(F.col("frame") <= frame_max)
    page = rows.orderBy("analysis_id", "frame", "class_id").offset(max(offset, 0)).limit(max(limit, 1))
    return page.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())
