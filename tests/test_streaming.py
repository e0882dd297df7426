"""Streams fed file by file give what the batch operators give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import islands
from spanloom.operators.temporal import Temporal, temporal_join
from spanloom.streaming.intervals import stream_before, stream_coalesce_audio, stream_intervals
from spanloom.streaming.run import drain


def base():
    return F.lit("2024-01-01").cast("timestamp")


def late(frames):
    return {"started": base(), "fps": 25, "lateness": f"{frames // 25} seconds"}


def feed(spark, tmp_path, rows, schema, parts, name):
    """Rows in time order over several files, one file per batch."""
    path = tmp_path / name
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode(
            "append").parquet(str(path / f"p={i}"))
    typed = spark.createDataFrame(rows[:1], schema).schema
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(str(path / "p=*"))


# A last recording, a day on: it lets the stream leave all others behind.
END = [(9, "x", 0)]


def day(id_="analysis_id"):
    return F.timestamp_micros(F.unix_micros(base()) + (F.col(id_) == 9).cast("long") * 86_400_000_000)


@pytest.mark.parametrize("parts", [1, 6])
def test_frames_to_intervals(spark, tmp_path, parts):
    rng = random.Random(1)
    rows = sorted(((rng.choice([1, 2]), rng.choice(["x", None]), rng.randrange(0, 3000)) for _ in range(150)), key=lambda r: r[2])
    schema = "analysis_id int, relation_type string, frame long"
    keys = ["analysis_id", "relation_type"]
    stream = feed(spark, tmp_path, rows + END, schema, parts, "f")
    got = drain(spark, stream_intervals(stream, 10, keys, started=day(), fps=25, lateness="2 minutes"))
    batch = islands.frames_to_intervals(spark.createDataFrame(rows, schema), 10, keys)
    want = batch.select(*keys, "start_frame", "end_frame")
    assert sorted(map(str, got.where("analysis_id < 9").select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("analysis_id = 9").count() == 0


def test_state_falls(spark, tmp_path):
    """What is closed leaves the state: by its own recording's progress, and all of it by the stream's."""
    rows = [(r, "x", f) for f in range(0, 4000, 40) for r in (1, 2, 3)] + [(1, "x", f) for f in range(4000, 9000, 40)] + END * 60
    stream = feed(spark, tmp_path, rows, "analysis_id int, relation_type string, frame long", 9, "f")
    progress = []
    got = drain(spark, stream_intervals(stream, 10, ["analysis_id", "relation_type"], started=day(), fps=25,
                                        lateness="1 seconds"), progress).collect()
    assert sorted((r.analysis_id, r.start_frame) for r in got) == sorted((r, f) for r, _, f in set(rows) - set(END))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) > held[-1] and held[-1] <= 2, held


def test_rows_later_than_stated_are_dropped(spark, tmp_path):
    rows = [(1, "x", 1000), (1, "x", 2000), (1, "x", 990), (1, "x", 1990)] + END
    stream = feed(spark, tmp_path, rows, "analysis_id int, relation_type string, frame long", 5, "f")
    got = drain(spark, stream_intervals(stream, 10, ["analysis_id", "relation_type"], started=day(), fps=25, lateness="4 seconds"))
    assert sorted((r.start_frame, r.end_frame) for r in got.collect()) == [(1000, 1000), (1990, 2000)]


def test_append_closes_intervals(spark, tmp_path):
    rows = [(1, "x", f) for f in (0, 10, 20, 500, 510, 5000, 9000)]
    stream = feed(spark, tmp_path, rows, "analysis_id int, relation_type string, frame long", 7, "f")
    got = drain(spark, stream_intervals(stream, 10, ["analysis_id", "relation_type"], **late(0)))
    assert sorted((r.start_frame, r.end_frame) for r in got.collect())[:2] == [(0, 20), (500, 510)]


def test_a_recording_that_begins_later_is_not_late(spark, tmp_path):
    """Each recording counts its frames from 0; only its start tells that the second one is not old."""
    first = [("a", "x", f, "2024-01-01 10:00:00") for f in range(0, 2000, 10)]
    second = [("b", "x", f, "2024-01-01 10:05:00") for f in range(0, 50, 10)]
    third = [("c", "x", 0, "2024-01-01 11:00:00")] * 200
    stream = feed(spark, tmp_path, first + second * 40 + third, "analysis_id string, relation_type string, frame long, at string",
                  3, "f")
    got = drain(spark, stream_intervals(stream, 10, ["analysis_id", "relation_type"], started=F.col("at").cast("timestamp"),
                                        fps=25, lateness="0 seconds"))
    rows = {(r.analysis_id, r.start_frame, r.end_frame) for r in got.collect()}
    assert {("a", 0, 1990), ("b", 0, 40)} <= rows


@pytest.mark.parametrize("parts", [1, 4])
def test_coalesce_audio(spark, tmp_path, parts):
    rng = random.Random(2)
    rows = sorted(((1, rng.choice("ab"), s, s + rng.choice([0, 5, 60]), rng.random())
                   for s in (rng.randrange(2000) for _ in range(160))), key=lambda r: r[2])
    schema = "analysis_id int, audio_class string, start_frame long, end_frame long, confidence double"
    stream = feed(spark, tmp_path, rows + [(9, "a", 0, 1, 0.5)], schema, parts, "a")
    columns = ["analysis_id", "audio_class", "start_frame", "end_frame", "confidence"]
    got = drain(spark, stream_coalesce_audio(stream, 6, started=day(), fps=25, lateness="2 minutes"))
    batch = islands.coalesce_audio(spark.createDataFrame(rows, schema), 6)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    with pytest.raises(ValueError):
        stream_coalesce_audio(stream, 0, **late(0))


@pytest.mark.parametrize("rho, strict", [(0, False), (3, True)])
def test_bounded_before(spark, tmp_path, rho, strict):
    rng = random.Random(3)

    def rows(n):
        return sorted(((rng.choice([1, 2]), s, s + rng.choice([0, 4, 20])) for s in
                       (rng.randrange(600) for _ in range(n))), key=lambda r: r[1])

    left, right = rows(60), rows(60)
    ls, rs = "analysis_id int, r_sf long, r_ef long", "analysis_id int, s_sf long, s_ef long"
    got = drain(spark, stream_before(
        feed(spark, tmp_path, left, ls, 3, "l"), feed(spark, tmp_path, right, rs, 3, "r"), 15, rho=rho,
        strict=strict, left_started=base(), right_started=base(), fps=25, lateness="80 seconds"))
    batch = temporal_join(
        spark.createDataFrame(left, ls), spark.createDataFrame(right, rs).withColumnRenamed("analysis_id", "k"),
        Temporal("Bef", delta=15, rho=rho, zeta="<" if strict else "<="), on=[("analysis_id", "k")],
        left_bounds=("r_sf", "r_ef"), right_bounds=("s_sf", "s_ef"))
    columns = ["analysis_id", "r_sf", "r_ef", "s_sf", "s_ef"]
    want = sorted(map(tuple, batch.select(columns).collect()))
    assert want and sorted(map(tuple, got.select(columns).collect())) == want
