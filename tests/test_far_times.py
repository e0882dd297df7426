"""Recordings of a stream that begin after the year 2262, the last one that pandas' timestamps hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.streaming.intervals import stream_intervals
from spanloom.streaming.run import drain


def test_intervals_close_in_any_year(spark, tmp_path):
    schema = "analysis_id long, relation_type string, frame long"
    rows = [(200_000, "x", f) for f in (0, 10, 20, 500)] + [(9_000_000, "x", 3), (9_000_001, "x", 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "f"))
    started = F.timestamp_seconds((F.col("analysis_id") + 1) * 86400)
    got = drain(spark, stream_intervals(stream, 10, ["analysis_id", "relation_type"], started=started, fps=25,
                                        lateness="4 seconds")).where("analysis_id < 9000001")
    assert sorted((r.analysis_id, r.start_frame, r.end_frame) for r in got.collect()) == [
        (200_000, 0, 20), (200_000, 500, 500), (9_000_000, 3, 3)]
