"""What the search over many tiles sends: pairs of a query and a tile without vectors, in few groups a tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import nearest
from test_memory import ENTRIES, brute, clustered


def test_routes_hold_no_vectors_and_groups_are_few(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LOOKED", 300, raising=False)
    rows = clustered(5, 300)
    df = spark.createDataFrame(rows, ENTRIES).repartition(3)
    queries = df.select("analysis_id", F.struct("frame", "class_id").alias("query_id"), "frame", "embedding")
    found, asks, sent = nearest.steps(queries, df, 4, 20)
    got = {}
    for r in nearest._least(found, 4).join(asks.select("q", "analysis_id", "query_id"), "q").orderBy("place").collect():
        got.setdefault((r.analysis_id, r.query_id.frame, r.query_id.class_id), []).append((r.frame, r.class_id))
    want = brute(rows, 4)
    assert {q: got.get(q, []) for q in want} == want
    for met in sent:
        assert "v" not in met.columns
        # All queries of a recording are fewer than ASKED, so they are one group.
        assert met.groupBy("analysis_id", "tile").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] == 1
