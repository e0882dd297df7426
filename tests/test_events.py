"""The canonical events on the 87 annotated intervals of FIXTURES.md."""

from __future__ import annotations

import os
import re
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from spanloom.operators.chain import Condition, chain
from spanloom.operators.select import pick, select_intervals
from spanloom.operators.temporal import Temporal
from spanloom.plans.events import Thresholds, detect, detect_all, detect_by_rows, parameters_of
from spanloom.vocab import EVENTS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def scenes(spark):
    pattern = re.compile(
        r"^\| (\d+) \| (audio|visual) \| (\w+) \| [\d.]+ \| [\d.]+ \| (\d+) \| (\d+) \|")
    with open(os.path.join(ROOT, "FIXTURES.md")) as f:
        found = [m.groups() for m in map(pattern.match, f) if m]
    assert len(found) == 87
    rows = spark.createDataFrame([(int(s), m, c, int(a), int(b)) for s, m, c, a, b in found],
                                 "analysis_id int, modality string, label string, sf long, ef long")
    # The annotations name no participants: give every interval all classes.
    people = F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(c).alias("class"))
                       for i, c in enumerate(("person", "vehicle", "object"))])
    visual = rows.where("modality = 'visual'").select(
        "analysis_id", F.col("label").alias("relation_type"), "sf", "ef", people.alias("participants"))
    audio = rows.where("modality = 'audio'").select(
        "analysis_id", F.col("label").alias("audio_class"), "sf", "ef", F.lit(1.0).alias("confidence"))
    return visual.cache(), audio.cache()


def found_in(rows):
    return sorted({r.analysis_id for r in rows.select("analysis_id").collect()})


@pytest.mark.parametrize("event, condition, options, want", [
    ("fight", "B", {}, [4, 5, 6, 29, 30]),
    ("gunshot_or_explosion", "B", {}, [7, 8, 9, 10, 11]),
    ("gunshot_or_explosion", "A", {}, [7, 8, 9, 10, 11]),
    ("vehicle_escape", "A", {}, [12, 13, 14, 31, 32]),
    # Intervals that only touch are no SP without tolerance.
    ("vehicle_escape", "B", {}, []),
    ("vehicle_escape", "B", {"rho": 1 / 24}, [12, 13, 14, 31, 32]),
    ("vehicle_collision", "B", {}, []),
    ("vehicle_collision", "B", {"rho": 1 / 24}, [15, 16, 17, 34]),
    ("vehicle_collision", "A", {}, [15, 16, 17, 33, 34]),
    ("suspicious_near_vehicle", "A", {}, [18, 19, 20, 35, 36]),
    ("suspicious_near_vehicle", "B", {}, []),
])
def test_golden_scenes(scenes, event, condition, options, want):
    assert found_in(detect(event, condition, *scenes, Thresholds(fps=24).everywhere(**options))) == want
    if condition != "A" or event != "vehicle_escape":
        rows = detect(event, condition, *scenes, Thresholds(fps=24).everywhere(**options), strategy="recording")
        assert found_in(rows) == want


def test_without_participants(scenes):
    """The golden results that leave the argument conditions out."""
    visual, audio = scenes
    altercation = select_intervals(pick("physical_altercation"), visual, audio)
    assert found_in(altercation) == [4, 5, 6, 29, 30]
    carrying = select_intervals(pick("carrying"), visual, audio)
    assert found_in(chain([carrying, carrying], [Temporal("Bef")])) == [21, 23]
    assert found_in(chain([carrying, carrying], [Temporal("LOJ")],
                          [Condition("M1.sf", "!=", "M2.sf")])) == [22, 23, 37, 38]
    engine, squeal = (select_intervals(pick(c), visual, audio) for c in ("engine", "tire_squeal"))
    assert found_in(chain([engine, squeal], [Temporal("Bef", delta=1)])) == [12, 13, 14, 31, 32]


def test_union_contains_both_sides(scenes):
    rows = detect_all(*scenes, Thresholds(fps=24).everywhere(rho=1 / 24)).collect()
    key = lambda r: (r.analysis_id, r.event_id, r.modality, r.arg1, r.arg2, r.arg3, r.sf, r.ef)
    by = {c: {key(r) for r in rows if r.condition == c} for c in "ABC"}
    assert by["A"] <= by["C"] and by["B"] <= by["C"] and by["C"] == by["A"] | by["B"]
    shared = [r for r in rows if r.condition == "C" and r.event_id not in ("handoff", "suspicious_near_vehicle")]
    assert len(shared) == len({key(r) for r in shared})


def test_detect_all_equals_single_detections(scenes):
    thresholds = Thresholds(fps=24).everywhere(rho=1 / 24)
    every = detect_all(*scenes, thresholds)
    for event, condition in (("fight", "C"), ("vehicle_escape", "A"), ("vehicle_collision", "B"),
                             ("handoff", "C")):
        one = detect(event, condition, *scenes, thresholds)
        same = every.where((F.col("event_id") == event) & (F.col("condition") == condition))
        assert sorted(map(str, one.collect())) == sorted(map(str, same.drop("condition").collect()))


def test_named_parameters(scenes):
    base = Thresholds(fps=24)
    wide = base.named({"delta_audio_fight": "inf", "rho_audio_vehicle_escape": 1, "zeta_visual_handoff": "<"},
                      unit="frames")
    assert wide.pairs["fight", "audio"].delta is None
    assert wide.pairs["handoff", "visual"].zeta == "<"
    assert found_in(detect("vehicle_escape", "B", *scenes, wide)) == [12, 13, 14, 31, 32]
    assert found_in(detect("vehicle_collision", "B", *scenes, wide)) == []
    short = base.named({"delta_audio_fight": 0})
    assert found_in(detect("fight", "B", *scenes, short)) == [4, 5, 30]
    for bad in ({"delta_audio_handoff": 1}, {"zeta_audio_fight": "=="}, {"speed": 3}):
        with pytest.raises(ValueError):
            base.named(bad)


def test_seconds_equal_frames(scenes):
    visual, audio = (df.withColumn("st", F.col("sf") / 24).withColumn("et", F.col("ef") / 24)
                     for df in scenes)
    for event, condition in (("fight", "B"), ("vehicle_escape", "A"), ("suspicious_near_vehicle", "A")):
        seconds = detect(event, condition, visual, audio, Thresholds(fps=1, bounds=("st", "et")))
        frames = detect(event, condition, *scenes, Thresholds(fps=24))
        assert found_in(seconds) == found_in(frames)


def test_parameters_as_rows_equal_single_runs(scenes):
    """Two settings in one job, and settings that differ by recording, equal runs of their own."""
    base = Thresholds(fps=24)
    settings = {"authored": base, "loose": base.everywhere(rho=1 / 24).named({"delta_audio_fight": "inf", "zeta_visual_handoff": "<"})}
    spark = scenes[0].sparkSession
    columns = ["analysis_id", "event_id", "modality", "arg1", "arg2", "arg3", "sf", "ef"]

    def rows(df):
        return sorted(map(str, df.select(columns).collect()))

    both = detect_by_rows(*scenes, parameters_of(settings, spark), base).cache()
    alone = {}
    for name, t in settings.items():
        each = [detect(event, c, *scenes, t) for event in EVENTS for c in ("A", "B")]
        alone[name] = rows(reduce(DataFrame.union, each))
        assert rows(both.where(f"setting = '{name}'")) == alone[name] and alone[name]
    assert alone["authored"] != alone["loose"]
    ids = scenes[0].select("analysis_id").union(scenes[1].select("analysis_id")).distinct()
    own = parameters_of(settings, spark).join(ids, F.when(F.col("analysis_id") % 2 == 0, "loose").otherwise("authored") == F.col("setting"))
    mixed = detect_by_rows(*scenes, own.withColumn("setting", F.lit("own")), base)
    pairs = both.where("(event_id, modality) IN (('fight', 'audio'), ('handoff', 'visual'), ('vehicle_escape', 'visual'), "
                       "('vehicle_escape', 'audio'), ('vehicle_collision', 'audio'))")
    want = pairs.where((F.col("setting") == "loose") == (F.col("analysis_id") % 2 == 0))
    assert rows(mixed.join(want.select("event_id", "modality").distinct(), ["event_id", "modality"], "left_semi")) == rows(want)


def test_both_tables_are_read_once(spark, scenes, tmp_path):
    for name, df in zip(("visual", "audio"), scenes):
        df.write.parquet(str(tmp_path / name))
    stored = [spark.read.parquet(str(tmp_path / name)) for name in ("visual", "audio")]
    rows = detect_all(*stored, Thresholds(fps=24))
    rows.collect()
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    final = plan.split("Initial Plan")[0]
    assert final.count("- Scan parquet") == 2 and "ReusedExchange" in final, final
