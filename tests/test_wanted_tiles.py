"""What the last step of the search sends, and that no row goes through the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import nearest, similarity
from test_memory import ENTRIES, brute, clustered


def asked(spark, rows):
    df = spark.createDataFrame(rows, ENTRIES).repartition(3)
    return df, df.select("analysis_id", F.struct("frame", "class_id").alias("query_id"), "frame", "embedding")


def neighbours(found, asks, k):
    got = {}
    for r in nearest._least(found, k).join(asks.select("q", "analysis_id", "query_id"), "q").orderBy("place").collect():
        got.setdefault((r.analysis_id, r.query_id.frame, r.query_id.class_id), []).append((r.frame, r.class_id))
    return got


def spied(monkeypatch):
    """What is written between the steps: plans and row counts by purpose."""
    plans, counts, write = {}, {}, nearest._written

    def written(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, purpose)
        counts[purpose] = out.count()
        return out

    monkeypatch.setattr(nearest, "_written", written)
    return plans, counts


@pytest.mark.parametrize("single", [1 << 16, 7])
def test_vectors_without_structure(spark, monkeypatch, single):
    """All tiles may hold more, yet what is written has a row for each tile and part, not for each query and tile."""
    for name, value in (("HELD", 40), ("WAITING", 50), ("SINGLE", single)):
        monkeypatch.setattr(nearest, name, value, raising=False)
    rng = np.random.default_rng(8)
    rows = [(1, i // 2, i, rng.standard_normal(12).tolist()) for i in range(400)]
    # Copies, more than are wanted, and one without length.
    rows += [(1, 150 + i, 500 + i, rows[9][3]) for i in range(9)] + [(1, 180, 600, [0.0] * 12), (1, 190, 601, [0.0] * 12)]
    df, queries = asked(spark, rows)
    plans, counts = spied(monkeypatch)
    found, asks, sent = nearest.steps(queries, df, 4, 20)
    want = brute(rows, 4)
    got = neighbours(found, asks, 4)
    assert {q: got.get(q, []) for q in want} == want
    assert sent[1].count() > 1000 and counts["further"] < 60


def test_nothing_is_broadcast(spark, monkeypatch):
    """Files of the steps are small beside their rows, so by their size they would be broadcast."""
    rows = clustered(4, 300)
    df, queries = asked(spark, rows)
    plans, _ = spied(monkeypatch)
    found = nearest.nearest_earlier(queries, df, 4, 20)
    plans["found"] = found._jdf.queryExecution().executedPlan().toString()
    # The running sum behind the tiles broadcasts a row a chunk.
    assert [p for p, text in plans.items() if "Broadcast" in text and p != "tiles"] == []
    assert len(plans) >= 6


def test_frames_that_are_asked_for_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([r for r in clustered(4, 60) if None not in r], ENTRIES).write.parquet(str(tmp_path / "m"))
    objects = spark.read.parquet(str(tmp_path / "m"))
    for rows in (similarity.similar_objects(objects, objects, 1, 3, 5), similarity.recent_objects(objects, objects, 1, 3)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
