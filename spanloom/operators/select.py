"""Selecting intervals by label and participant class, and projecting results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.time import frames_to_seconds
from spanloom.vocab import AUDIO_CLASSES


@dataclass(frozen=True)
class Branch:
    """Labels together with the classes each argument slot admits."""

    labels: tuple[str, ...]
    classes: Mapping[int, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Selection:
    """One or more branches; a row matches if any branch matches as a whole."""

    branches: tuple[Branch, ...]

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(lb for b in self.branches for lb in b.labels))

    @property
    def slots(self) -> tuple[int, ...]:
        return tuple(sorted({k for b in self.branches for k in b.classes}))

    def source(self, audio_labels: Iterable[str] = AUDIO_CLASSES) -> str:
        taxonomy = set(audio_labels)
        kinds = {"audio" if lb in taxonomy else "visual" for lb in self.labels}
        if len(kinds) > 1:
            raise ValueError(f"selection mixes audio and visual labels: {', '.join(self.labels)}")
        return kinds.pop()

    def slot_class(self, slot: int) -> str:
        """Name for an argument slot: its class, or ``arg`` when branches disagree."""
        names = {c for b in self.branches for c in b.classes.get(slot, ())}
        return names.pop() if len(names) == 1 else f"arg{slot}"


def pick(*labels: str, **slots: str | Sequence[str]) -> Selection:
    """``pick("carrying", arg1="person", arg2="object")``."""
    classes = {
        int(name.removeprefix("arg")): (value,) if isinstance(value, str) else tuple(value)
        for name, value in slots.items()
    }
    return Selection((Branch(tuple(dict.fromkeys(labels)), classes),))


def any_of(*selections: Selection) -> Selection:
    return Selection(tuple(b for s in selections for b in s.branches))


def select_intervals(selection: Selection, visual: DataFrame, audio: DataFrame, *,
                     min_confidence: float = 0.0,
                     audio_labels: Iterable[str] = AUDIO_CLASSES) -> DataFrame:
    """Rows (analysis_id, argN.., sf, ef) of the intervals a selection admits.

    ``visual``: analysis_id, relation_type, sf, ef, participants (array of
    class_id, class).  ``audio``: analysis_id, audio_class, sf, ef, confidence.
    Any further time columns (st, et) are kept.
    """
    if selection.source(audio_labels) == "audio":
        top = max(selection.slots, default=0)
        args = [f"CAST(NULL AS INT) AS arg{k}" for k in range(1, top + 1)]
        return audio.where(
            f"audio_class IN {_listed(selection.labels)} AND confidence >= {float(min_confidence)!r}"
        ).selectExpr("analysis_id", *args, *_times(audio))
    rows = visual.where(f"relation_type IN {_listed(selection.labels)}")
    rows = participant_slots(rows, selection)
    args = [f"__p{k}.class_id AS arg{k}" for k in selection.slots]
    if len(selection.branches) > 1:
        rows = rows.where(" OR ".join(_branch_condition(b) for b in selection.branches))
    return rows.selectExpr("analysis_id", *args, *_times(visual))


def _listed(values: Sequence[str]) -> str:
    """A SQL list of string literals."""
    return "(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _times(df: DataFrame) -> list[str]:
    return [c for c in ("sf", "ef", "st", "et", "fps") if c in df.columns]


def _branch_condition(branch: Branch) -> str:
    terms = [f"relation_type IN {_listed(branch.labels)}"]
    terms += [f"__p{k}.class IN {_listed(classes)}" for k, classes in branch.classes.items()]
    return "(" + " AND ".join(terms) + ")"


def participant_slots(rows: DataFrame, selection: Selection) -> DataFrame:
    """Every way to fill the argument slots from an interval's participants.

    The participants travel inside the row, so filling a slot is an explode and
    needs no join.  Two slots of one class yield both orders and self pairs.
    """
    for k in selection.slots:
        options = "participants"
        if all(k in b.classes for b in selection.branches):
            wanted = sorted({c for b in selection.branches for c in b.classes[k]})
            options = f"filter(participants, p -> p.class IN {_listed(wanted)})"
        rows = rows.selectExpr("*", f"explode({options}) AS __p{k}")
    return rows


def split_valid(intervals: DataFrame, start: str = "sf", end: str = "ef") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): an interval must not end before it starts or lack a bound."""
    good = F.coalesce(F.col(start) <= F.col(end), F.lit(False))
    return intervals.where(good), intervals.where(~good)


def with_seconds(intervals: DataFrame, fps: Column) -> DataFrame:
    """Add the time-domain bounds st, et to the frame-domain ones."""
    return intervals.withColumn("st", frames_to_seconds(F.col("sf"), fps)).withColumn(
        "et", frames_to_seconds(F.col("ef"), fps))


def attach_participants(intervals: DataFrame, participants: DataFrame) -> DataFrame:
    """Nest a child participant table into its intervals by relation_id."""
    nested = participants.groupBy("relation_id").agg(
        F.array_sort(F.collect_set(F.struct("class_id", "class"))).alias("participants"))
    return intervals.join(nested, "relation_id", "left").withColumn(
        "participants", F.coalesce("participants",
                                   F.array().cast(nested.schema["participants"].dataType)))


def label_participants(intervals: DataFrame, classes: DataFrame) -> DataFrame:
    """Look up each participant's class; ``unknown`` where none was seen.

    ``intervals.participants`` holds bare ids; ``classes`` is one row per
    (analysis_id, class_id).
    """
    ids = intervals.withColumn("class_id", F.explode("participants")).drop("participants")
    return ids.join(classes, ["analysis_id", "class_id"], "left").withColumn(
        "class", F.coalesce("class", F.lit("unknown")))


def route_by_taxonomy(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Mark each label row audio or visual by membership in the taxonomy table."""
    known = taxonomy.select(F.col("audio_class").alias("label"), F.lit("audio").alias("__src"))
    return labels.join(known, "label", "left").withColumn(
        "source", F.coalesce("__src", F.lit("visual"))).drop("__src")
