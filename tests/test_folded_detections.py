"""What the detection join sorts is narrow, and flags fold right behind it."""

from __future__ import annotations

from spanloom.plans import events
from spanloom.plans.views import Views

SF_DIR = "/root/testdata/sf0.001"


def test_conditions_equal_those_of_all_events_and_names_stay_out_of_the_join(spark, monkeypatch):
    v, sides = Views(spark, SF_DIR), []
    join = events.either_join
    monkeypatch.setattr(events, "either_join", lambda left, *a, **k: sides.append(left.columns) or join(left, *a, **k))
    got = sorted(map(tuple, events.detected_conditions(v.visual, v.audio, events.Thresholds(fps=24)).collect()))
    assert not {"event_id", "modality", "op"} & set(sides[0])
    every = events.detect_all(v.visual, v.audio, events.Thresholds(fps=24))
    assert got == sorted(map(tuple, every.select("analysis_id", "event_id", "condition").distinct().collect())) and got
