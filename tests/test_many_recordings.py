"""Many short recordings in a stream share keys, and each one still closes by itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import islands
from spanloom.streaming import closing
from spanloom.streaming.intervals import stream_coalesce_audio
from spanloom.streaming.run import drain
from test_streaming import feed

SCHEMA = "analysis_id long, audio_class string, start_frame long, end_frame long, confidence double"


@pytest.mark.parametrize("parts", [1, 5])
def test_recordings_share_keys(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(closing, "BUCKETS", 8, raising=False)
    rng = random.Random(6)
    rows = [(r, rng.choice(["a", "b", None]), s, s + rng.choice([0, 5, 60]), rng.random())
            for r in range(120) for s in sorted(rng.randrange(2000) for _ in range(6))]
    stream = feed(spark, tmp_path, rows + [(120, "a", 0, 1, 0.5)], SCHEMA, parts, "a")
    progress = []
    started = F.timestamp_seconds((F.col("analysis_id") + 1) * 86400)
    got = drain(spark, stream_coalesce_audio(stream, 6, started=started, fps=25, lateness="4 seconds"), progress)
    columns = ["analysis_id", "audio_class", "start_frame", "end_frame", "confidence"]
    want = islands.coalesce_audio(spark.createDataFrame(rows, SCHEMA), 6).select(columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))
    timers = [int(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"]) for p in progress]
    assert 0 < timers[0] <= 8
    # Only the last recording is left.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_one_of_a_key_closes_before_the_other(spark, tmp_path, monkeypatch):
    """By the timer, while the other recording of the key goes on; rows later than the stream's watermark are dropped."""
    monkeypatch.setattr(closing, "BUCKETS", 1, raising=False)
    batches = [[(1, "a", 0, 10, 0.5), (2, "a", 0, 10, 0.1), (2, "a", 500, 510, None)],
               [(2, "a", 100, 110, 0.9), (2, "a", 505, 520, 0.2), (1, "a", 12, 20, 0.7)],
               [(2, "a", 700, 701, 0.3)] * 3, [(2, "a", 90_000, 90_001, 0.3)] * 3]
    rows = [r for b in batches for r in b]
    stream = feed(spark, tmp_path, rows, SCHEMA, 4, "a")
    started = F.timestamp_seconds(F.lit(86400) + F.when(F.col("analysis_id") == 2, 1000).otherwise(995))
    got = drain(spark, stream_coalesce_audio(stream, 6, started=started, fps=25, lateness="8 seconds"))
    assert sorted(tuple(r)[:4] for r in got.select("analysis_id", "start_frame", "end_frame", "confidence").collect()) == [
        (1, 0, 10, 0.5), (2, 0, 10, 0.1), (2, 500, 520, 0.2), (2, 700, 701, 0.3)]
