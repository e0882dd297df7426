"""Inputs that once lost rows or ended a job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions.time import unbounded
from spanloom.operators import identity, ingest, islands, setops
from spanloom.operators.temporal import Temporal, temporal_join
from spanloom.session import scratch_dir
from spanloom.sources import tables


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_unbounded_and_far_thresholds_pass_the_buckets(spark, how):
    left = spark.createDataFrame([(1, 0, 10, None), (1, 0, 12, 5), (1, 0, 14, 900), (2, 0, 1, 3)],
                                 "a int, rs int, re int, d int")
    right = spark.createDataFrame([(1, s, s + 5) for s in (15, 60, 300, 5_000)], "b int, ss int, se int")

    def joined(strategy):
        return sorted(map(tuple, temporal_join(
            left, right, Temporal("Bef", delta=F.col("d"), bucket_delta=60), on=[("a", "b")],
            left_bounds=("rs", "re"), right_bounds=("ss", "se"), how=how, strategy=strategy).collect()), key=str)

    assert joined("auto") == joined("recording")
    if how == "inner":
        assert len(joined("auto")) == 4 + 1 + 3


def test_bucketed_scan_of_integer_ids(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("analysis_id"), F.lit(1).alias("frame"))
    tables.write_table(rows, str(tmp_path / "t"), buckets=8)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert {r.analysis_id for r in tables.scan(stored, [3, 7, 11], 8).collect()} == {3, 7, 11}


def test_threshold_text_is_a_whole_number_or_fails(spark):
    def read(text):
        return spark.createDataFrame([(text,)], "t string").select(unbounded(F.col("t"))).first()[0]

    assert [read("inf"), read(" ∞ "), read("7"), read(None)] == [None, None, 7, None]
    for text in ("2.5", "abc", ""):
        with pytest.raises(Exception, match="not a whole number"):
            read(text)


def test_lists_in_wrappers(spark):
    def parsed(text):
        objects, rejected = ingest.parse_objects(spark.createDataFrame([(text,)], "response string"))
        return [(r["class"], r["blocks"]) for r in objects.orderBy("ordinal").collect()], rejected.count()

    item = '{"class": "person", "blocks": [1]}'
    assert parsed('{"tags": ["a"], "objects": [%s]}' % item) == ([("person", [1])], 0)
    assert parsed('{"a": {"b": {"c": {"d": [%s]}}}}' % item) == ([("person", [1])], 0)
    assert parsed('{"a": {"tags": [1]}, "b": "x"}') == ([], 1)
    assert parsed('{"objects": []}') == ([], 0)
    blocks = [("99999999999", []), ('"3"', []), ("3", [3]), ("2.7", [2]), ("null", [])]
    for text, expected in blocks:
        assert parsed('[{"class": "person", "blocks": %s}]' % text) == ([("person", expected)], 0)


def test_real_starts_and_gaps_of_each_recording(spark):
    real = spark.createDataFrame([(1, 0.0, 0.1), (1, 0.5, 0.6), (1, 0.6, 0.9)], "k int, s double, e double")
    assert sorted((r.s, r.e) for r in islands.merge_close(real, ["k"], "s", "e", 0).collect()) == [(0.0, 0.1), (0.5, 0.9)]
    assert [(r.s, r.e) for r in islands.merge_close(real, ["k"], "s", "e", 1).collect()] == [(0.0, 0.9)]
    frames = [(k, f, k) for k in (1, 5, 20) for f in (0, 2, 12, 60)]
    mixed = spark.createDataFrame(frames, "analysis_id int, frame long, rate int")
    got = sorted((r.analysis_id, r.start_frame, r.end_frame)
                 for r in islands.frames_to_intervals(mixed, "rate", ["analysis_id"]).collect())
    want = [tuple(r) for k in (1, 5, 20) for r in islands.frames_to_intervals(
        mixed.where(f"analysis_id = {k}"), k, ["analysis_id"]).select("analysis_id", "start_frame", "end_frame").collect()]
    assert got == sorted(want)


def test_odd_ids_drop_their_object_only(spark):
    rows = [("r", 1, k, raw, "person", [1]) for k, raw in enumerate(["--5", "²", str(2**40), "7", "new"])]
    rows.append((None, 1, 0, "new", "person", [1]))
    objects = spark.createDataFrame(
        rows, "analysis_id string, frame long, ordinal int, raw_id string, class string, blocks array<int>")
    assert sorted((r.ordinal, r.class_id) for r in identity.track(objects, rate=1).collect()) == [(3, 7), (4, 1)]


def test_positional_sets_pad_either_side(spark):
    wide = spark.createDataFrame([(1, "a", 2), (3, "b", None)], "x int, y string, z int")
    slim = spark.createDataFrame([(3, "b"), (4, "c")], "p int, q string")
    assert sorted(map(tuple, setops.positional_union(slim, wide).collect()), key=str) == [
        (1, "a", 2), (3, "b", None), (4, "c", None)]
    assert setops.positional_union(slim, wide).columns == ["p", "q", "z"]
    assert list(map(tuple, setops.positional_difference(wide, slim).collect())) == [(1, "a", 2)]
    assert list(map(tuple, setops.positional_intersection(slim, wide).collect())) == [(3, "b", None)]


def test_scratch_is_local_only_in_local_mode(spark, monkeypatch):
    assert scratch_dir(spark, "x")
    monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077", raising=False)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            scratch_dir(spark, "x")
