"""Outcomes of expected and detected events, and the joins that make them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import matching, sweep


def test_outcomes_of_every_kind(spark):
    scenes = spark.createDataFrame([(1, "A"), (2, "A"), (2, "A"), (None, "A")], "scene int, condition string")
    expected = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, "A", "x"), (9, "A", "x"), (None, "A", "x")],
                                     "scene int, condition string, event string")
    detections = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (2, "A", "y"), (2, "A", "y"), (2, "A", "other"),
                                        (8, "A", "y"), (9, "A", "x"), (None, "A", "x")], expected.schema)
    got = matching.event_outcomes(scenes, expected, detections, ("x", "y"), ("scene", "condition"))
    assert got.columns == ["scene", "condition", "event", "detected", "result"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, "A", "x", True, "TP"), (1, "A", "y", True, "FP"), (2, "A", "x", False, "FN"), (2, "A", "y", True, "FP"),
        (9, "A", "x", True, "TP"), (None, "A", "x", False, "FN")], key=str)


@pytest.mark.parametrize("step", ["outcomes", "pairs"])
def test_no_exploded_side_is_broadcast(spark, tmp_path, step):
    """Its file is small, the rows made from it need not be."""
    spark.range(1000).select(F.col("id").alias("scene")).write.parquet(str(tmp_path / "s"))
    files = spark.read.parquet(str(tmp_path / "s"))
    names = F.explode(F.array(*[F.lit(c) for c in "ABCD"]))
    if step == "outcomes":
        scenes = files.select("scene", names.alias("condition"))
        events = scenes.select("scene", "condition", F.lit("x").alias("event"))
        rows = matching.event_outcomes(scenes, events, events, ("x", "y"), ("scene", "condition"))
    else:
        scenes = files.select("scene", names.alias("visual"), F.lit("A").alias("audio"))
        found = files.select(F.lit("A").alias("producer"), "scene", F.lit("x").alias("event"))
        rows = sweep.producer_pairs(found, found, scenes)
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()
