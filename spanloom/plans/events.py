"""The canonical complex events, as compositions of the interval operators.

Every plan covers all recordings at once and yields one aligned schema:
analysis_id, event_id, modality, arg1, arg2, arg3, sf, ef.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.chain import Condition, Duration, chain
from spanloom.operators.select import Selection, any_of, pick, select_intervals
from spanloom.operators.sliced import SLICE_ROWS
from spanloom.operators.temporal import Temporal, either_join
from spanloom.vocab import EVENTS, MODALITIES, STRICTNESS

ARGS = ("arg1", "arg2", "arg3")
CONDITIONS = ("A", "B", "C")


@dataclass(frozen=True)
class Pair:
    """Parameters of one event's temporal operator, distances in seconds (None = unbounded)."""

    delta: float | None = None
    zeta: str = "<="
    rho: float = 0


# The operators the events use and their authored parameters.
PAIRS: Mapping[tuple[str, str], Pair] = {
    ("fight", "audio"): Pair(delta=5),
    ("handoff", "visual"): Pair(),
    ("vehicle_collision", "audio"): Pair(),
    ("vehicle_escape", "visual"): Pair(delta=2),
    ("vehicle_escape", "audio"): Pair(),
}
_NAME = re.compile("^(delta|zeta|rho)_({})_(.+)$".format("|".join(MODALITIES)))


@dataclass(frozen=True)
class Thresholds:
    """Parameters of all events; ``fps`` turns seconds into frames.

    With ``bounds=("st", "et")`` the intervals carry seconds themselves and
    ``fps`` must be 1, which also serves recordings of different frame rates.
    """

    fps: int | float = 24
    bounds: tuple[str, str] = ("sf", "ef")
    pairs: Mapping[tuple[str, str], Pair] = field(default_factory=lambda: dict(PAIRS))
    suspicious_seconds: float = 3
    min_confidence: float = 0.0
    # Rows a side of one group in the unbounded handoff join of a single ``detect``, however hot an object is.
    handoff_rows: int = SLICE_ROWS

    def units(self, seconds: float | None) -> int | float | None:
        if seconds is None:
            return None
        return round(seconds * self.fps) if self.bounds == ("sf", "ef") else seconds

    def everywhere(self, **changes) -> Thresholds:
        """The same change to every pair, such as ``rho=1 / 24``."""
        return replace(self, pairs={k: replace(p, **changes) for k, p in self.pairs.items()})

    def named(self, values: Mapping[str, object], unit: str = "seconds") -> Thresholds:
        """Override by parameter names such as ``delta_audio_fight`` or ``zeta_visual_handoff``.

        Distances may be ``inf``; they are in ``unit`` (seconds or frames).
        """
        if unit not in ("seconds", "frames"):
            raise ValueError(f"unknown unit {unit!r}")
        pairs = dict(self.pairs)
        for name, value in values.items():
            match = _NAME.match(name)
            key = (match[3], match[2]) if match else None
            if key not in pairs:
                raise ValueError(f"no event parameter is named {name!r}")
            if match[1] == "zeta":
                if value not in STRICTNESS:
                    raise ValueError(f"invalid strictness {value!r} for {name!r}")
            elif value in ("inf", "∞"):
                value = None
            else:
                value = float(value) / (self.fps if unit == "frames" else 1)
            pairs[key] = replace(pairs[key], **{match[1]: value})
        return replace(self, pairs=pairs)


class _Scene:
    """The two interval tables plus thresholds, with the chain shorthands events use."""

    def __init__(self, visual: DataFrame, audio: DataFrame, thresholds: Thresholds,
                 strategy: str) -> None:
        self.visual, self.audio, self.t, self.strategy = visual, audio, thresholds, strategy

    def rows(self, selection: Selection) -> DataFrame:
        return select_intervals(selection, self.visual, self.audio,
                                min_confidence=self.t.min_confidence)

    def chain(self, selections, operators=(), conditions=(), slice_rows: int | None = None) -> DataFrame:
        return chain([self.rows(s) for s in selections], operators, conditions,
                     bounds=self.t.bounds, strategy=self.strategy, slice_rows=slice_rows)

    def pair(self, op: str, event: str, modality: str) -> Temporal:
        p = self.t.pairs[event, modality]
        return Temporal(op, delta=self.t.units(p.delta), zeta=p.zeta, rho=self.t.units(p.rho))

    def out(self, rows: DataFrame, args: Sequence[str], last: str = "M1") -> DataFrame:
        start, end = self.t.bounds
        slots = [*args, "NULL", "NULL", "NULL"][:3]
        return rows.selectExpr(
            "analysis_id", *[f"CAST({c} AS INT) AS {n}" for c, n in zip(slots, ARGS)],
            f"M1_{start} AS sf", f"{last}_{end} AS ef")


def _fight_visual(s: _Scene) -> DataFrame:
    who = pick("physical_altercation", arg1="person", arg2="person")
    return s.out(s.chain([who], (), [Condition("M1.arg1", "!=", "M1.arg2")]), ["M1_arg1", "M1_arg2"])


def _fight_audio(s: _Scene) -> DataFrame:
    rows = s.chain([pick("shout"), pick("impact")], [s.pair("Bef", "fight", "audio")])
    return s.out(rows, [], "M2")


def _gunshot_visual(s: _Scene) -> DataFrame:
    seen = any_of(pick("gunshot_visible", arg1="person"),
                  pick("explosion_visible", arg1=("vehicle", "object")))
    return s.out(s.chain([seen]), ["M1_arg1"])


def _gunshot_audio(s: _Scene) -> DataFrame:
    return s.out(s.chain([pick("gunshot_or_explosion")]), [])


def _handoff_visual(s: _Scene) -> DataFrame:
    carry = pick("carrying", arg1="person", arg2="object")
    rows = s.chain([carry, carry], [s.pair("Bef", "handoff", "visual")],
                   [Condition("M1.arg1", "!=", "M2.arg1"), Condition("M1.arg2", "=", "M2.arg2")],
                   slice_rows=s.t.handoff_rows)
    return s.out(rows, ["M1_arg1", "M2_arg1", "M1_arg2"], "M2")


def _suspicious_visual(s: _Scene) -> DataFrame:
    near = pick("suspicious_near_vehicle", arg1="person", arg2="vehicle")
    long_enough = Duration("M1", "M1", ">=", s.t.units(s.t.suspicious_seconds), s.t.bounds)
    return s.out(s.chain([near], (), [long_enough]), ["M1_arg1", "M1_arg2"])


def _collision_visual(s: _Scene) -> DataFrame:
    return s.out(s.chain([pick("vehicle_collision", arg1="vehicle")]), ["M1_arg1"])


def _collision_audio(s: _Scene) -> DataFrame:
    rows = s.chain([pick("horn", "skidding"), pick("impact", "glass_breaking")],
                   [s.pair("SP", "vehicle_collision", "audio")])
    return s.out(rows, [], "M2")


def _escape_visual(s: _Scene) -> DataFrame:
    rows = s.chain(
        [pick("running", arg1="person"),
         pick("enter_or_exit_vehicle", arg1="person", arg2="vehicle")],
        [s.pair("Bef", "vehicle_escape", "visual")], [Condition("M1.arg1", "=", "M2.arg1")])
    return s.out(rows, ["M1_arg1", "M2_arg2"], "M2")


def _escape_audio(s: _Scene) -> DataFrame:
    rows = s.chain([pick("engine"), pick("tire_squeal")], [s.pair("SP", "vehicle_escape", "audio")])
    return s.out(rows, [], "M2")


_VISUAL: dict[str, Callable[[_Scene], DataFrame]] = {
    "fight": _fight_visual,
    "gunshot_or_explosion": _gunshot_visual,
    "handoff": _handoff_visual,
    "suspicious_near_vehicle": _suspicious_visual,
    "vehicle_collision": _collision_visual,
    "vehicle_escape": _escape_visual,
}
_AUDIO: dict[str, Callable[[_Scene], DataFrame]] = {
    "fight": _fight_audio,
    "gunshot_or_explosion": _gunshot_audio,
    "vehicle_collision": _collision_audio,
    "vehicle_escape": _escape_audio,
}


def _parts(event: str, scene: _Scene) -> tuple[DataFrame, DataFrame | None]:
    """(visual, audio) detections of one event in the aligned schema."""

    def tagged(rows: DataFrame, modality: str) -> DataFrame:
        return rows.selectExpr("analysis_id", f"'{event}' AS event_id", f"'{modality}' AS modality",
                               *ARGS, "sf", "ef")

    heard = tagged(_AUDIO[event](scene), "audio") if event in _AUDIO else None
    return tagged(_VISUAL[event](scene), "visual"), heard


def _under(condition: str, seen: DataFrame, heard: DataFrame | None) -> DataFrame:
    if condition == "B":
        return seen.limit(0) if heard is None else heard
    if condition == "A" or heard is None:
        return seen
    return seen.union(heard).distinct()


def detect(event: str, condition: str, visual: DataFrame, audio: DataFrame,
           thresholds: Thresholds = Thresholds(), strategy: str = "auto") -> DataFrame:
    """Detections of one event: A visual, B audio, C the distinct union of both.

    An event without an acoustic form is the same under A and C and empty under B.
    """
    if event not in EVENTS or condition not in CONDITIONS:
        raise ValueError(f"unknown event or condition: {event!r}, {condition!r}")
    return _under(condition, *_parts(event, _Scene(visual, audio, thresholds, strategy)))


# -- all events in one pass --------------------------------------------------------

@dataclass(frozen=True)
class Single:
    """An event that one interval makes: which slots it gives out, and what must hold."""

    event: str
    modality: str
    first: Selection
    args: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Double:
    """An event of two intervals: the operator, slots that must agree, slots given out."""

    event: str
    modality: str
    op: str
    first: Selection
    second: Selection
    args: tuple[str, ...] = ()
    same: tuple[str, str] | None = None
    where: str = "true"


_CARRY = pick("carrying", arg1="person", arg2="object")
SINGLES = (
    Single("fight", "visual", pick("physical_altercation", arg1="person", arg2="person"), ("arg1", "arg2"), "arg1 != arg2"),
    Single("gunshot_or_explosion", "visual", any_of(pick("gunshot_visible", arg1="person"),
                                                    pick("explosion_visible", arg1=("vehicle", "object"))), ("arg1",)),
    Single("gunshot_or_explosion", "audio", pick("gunshot_or_explosion"), ()),
    Single("suspicious_near_vehicle", "visual", pick("suspicious_near_vehicle", arg1="person", arg2="vehicle"),
           ("arg1", "arg2"), "e - s >= {suspicious}"),
    Single("vehicle_collision", "visual", pick("vehicle_collision", arg1="vehicle"), ("arg1",)),
)
DOUBLES = (
    Double("fight", "audio", "Bef", pick("shout"), pick("impact")),
    Double("handoff", "visual", "Bef", _CARRY, _CARRY, ("m_arg1", "n_arg1", "m_arg2"), ("arg2", "arg2"), "m_arg1 != n_arg1"),
    Double("vehicle_collision", "audio", "SP", pick("horn", "skidding"), pick("impact", "glass_breaking")),
    Double("vehicle_escape", "visual", "Bef", pick("running", arg1="person"),
           pick("enter_or_exit_vehicle", arg1="person", arg2="vehicle"), ("m_arg1", "n_arg2"), ("arg1", "arg1")),
    Double("vehicle_escape", "audio", "SP", pick("engine"), pick("tire_squeal")),
)
PARAMETERS = "event_id string, modality string, delta double, zeta string, rho double"


def _uses(selection: Selection, use: int, same: str | None) -> list[tuple[str, str]]:
    """(label, SQL array of (use, arg1, arg2, same)): every way in which an interval serves the selection."""
    out = []
    for branch in selection.branches:
        values = {"arg1": "NULL", "arg2": "NULL"}
        made, inner = "", ""
        for k, classes in sorted(branch.classes.items()):
            names = ", ".join(f"'{c}'" for c in classes)
            values[f"arg{k}"] = f"p{k}.class_id"
            one = f"transform(filter(participants, q -> q.class IN ({names})), p{k} -> "
            made, inner = made + (f"flatten({one}" if k < max(branch.classes) else one), inner + (")) " if k < max(branch.classes) else ")")
        struct = (f"named_struct('use', {use}, 'arg1', CAST({values['arg1']} AS INT), 'arg2', CAST({values['arg2']} AS INT), "
                  f"'same', CAST({values.get(same, '-1') if same else '-1'} AS INT))")
        out += [(label, made + struct + inner if made else f"array({struct})") for label in branch.labels]
    return out


def _in_use(visual: DataFrame, audio: DataFrame, t: Thresholds, singles: Sequence[Single], doubles: Sequence[Double]) -> DataFrame:
    """analysis_id, use, arg1, arg2, same, s, e: each table is read once, each interval goes out for all it serves.

    Single i is use i; the two intervals of double i are uses 100 + 2 i and 101 + 2 i.
    """
    start, end = t.bounds
    parts = []
    for modality, rows, label in (("visual", visual, "relation_type"), ("audio", audio, "audio_class")):
        uses = [u for i, x in enumerate(singles) if x.modality == modality for u in _uses(x.first, i, None)]
        uses += [u for i, x in enumerate(doubles) if x.modality == modality for k, selection in enumerate((x.first, x.second))
                 for u in _uses(selection, 100 + 2 * i + k, x.same[k] if x.same else None)]
        by_label: dict[str, list[str]] = {}
        for name, array in uses:
            by_label.setdefault(name, []).append(array)
        if by_label:
            heard = rows.where(f"confidence >= {float(t.min_confidence)!r}") if modality == "audio" else rows
            cases = " ".join(f"WHEN '{name}' THEN {arrays[0] if len(arrays) == 1 else f'concat({chr(44).join(arrays)})'}"
                             for name, arrays in by_label.items())
            names = ", ".join(f"'{name}'" for name in by_label)
            parts.append(heard.where(f"{label} IN ({names})").selectExpr(
                "analysis_id", f"explode(CASE {label} {cases} END) AS u", f"{start} AS s", f"{end} AS e"))
    return reduce(DataFrame.union, parts).selectExpr("analysis_id", "u.*", "s", "e")


def parameters_of(settings: Mapping[str, Thresholds], spark) -> DataFrame:
    """One row for each setting and event of two intervals, distances in the unit of its intervals."""
    rows = [(name, x.event, x.modality, None if (d := t.units(p.delta)) is None else float(d), p.zeta, float(t.units(p.rho)))
            for name, t in settings.items() for x in DOUBLES for p in [t.pairs[x.event, x.modality]]]
    return spark.createDataFrame(rows, "setting string, " + PARAMETERS)


def detect_by_rows(visual: DataFrame, audio: DataFrame, parameters: DataFrame, thresholds: Thresholds = Thresholds(),
                   events: Sequence[str] = EVENTS) -> DataFrame:
    """Detections of all events in one pass, with the operators' parameters as rows.

    ``parameters``: setting, event_id, modality, delta (null: unbounded), zeta, rho, and
    analysis_id where recordings have their own.  Result: setting, analysis_id, event_id,
    modality, arg1-3, sf, ef, for every setting.  ``thresholds`` gives the bounds, the least
    confidence and the suspicious duration; its pairs are not used.

    Both tables are read once.  All events of two intervals share one join: a first interval
    meets the parameters, which say how far from it the second may start; that range lies on
    a bucket level of its own length, so events and settings of any reach spread alike.
    """
    t = thresholds
    singles = [x for x in SINGLES if x.event in events]
    doubles = [x for x in DOUBLES if x.event in events]
    # One exchange that all readers share.  Each takes all columns and filters behind an outer
    # explode: other columns, or a filter in front, would differ between them and undo the sharing.
    rows = _in_use(visual, audio, t, singles, doubles).hint("rebalance")

    def serving(condition: str) -> DataFrame:
        whole = f"array(struct({', '.join(rows.columns)}))"
        return rows.selectExpr(f"explode_outer(CASE WHEN {condition} THEN {whole} ELSE slice({whole}, 1, 0) END) AS kept").where(
            "kept IS NOT NULL").selectExpr("kept.*")

    def chosen(column: str, by: str, values: Sequence[object]) -> str:
        cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
        return f"CASE {by} {cases} END AS {column}" if values else f"NULL AS {column}"

    # A few names, as one value.
    named = F.explode(parameters.agg(F.collect_set("setting")).scalar())
    found = []
    if singles:
        ok = " ".join(f"WHEN {i} THEN {x.where.format(suspicious=t.units(t.suspicious_seconds))}" for i, x in enumerate(singles))
        texts = {c: [f"'{getattr(x, c)}'" for x in singles] for c in ("event", "modality")}
        out = serving("use < 100").where(f"CASE use {ok} END").selectExpr(
            "analysis_id", chosen("event_id", "use", texts["event"]), chosen("modality", "use", texts["modality"]),
            *[f"CAST({chosen(a, 'use', [a if a in x.args else 'NULL' for x in singles]).rpartition(' AS ')[0]} AS INT) AS {a}" for a in ARGS[:2]],
            "CAST(NULL AS INT) AS arg3", "s AS sf", "e AS ef")
        found.append(out.select(named.alias("setting"), *out.columns))
    if doubles:
        texts = {c: [f"'{getattr(x, c)}'" for x in doubles] for c in ("event", "modality", "op")}
        first = serving("use >= 100 AND use % 2 = 0").selectExpr(
            "analysis_id", "CAST((use - 100) DIV 2 AS INT) AS pair", "arg1 AS m_arg1", "arg2 AS m_arg2", "same", "s AS m_s", "e AS m_e")
        first = first.selectExpr("*", chosen("event_id", "pair", texts["event"]), chosen("modality", "pair", texts["modality"]))
        # The pair says these names again behind the join, whose sorts hold every column.
        first = first.join(parameters, ["event_id", "modality"] + [c for c in ("analysis_id",) if c in parameters.columns]).drop(
            "event_id", "modality")
        second = serving("use >= 100 AND use % 2 = 1").selectExpr(
            "analysis_id AS n_id", "CAST((use - 100) DIV 2 AS INT) AS n_pair", "arg1 AS n_arg1", "arg2 AS n_arg2", "same AS n_same",
            "s AS n_s", "e AS n_e")
        where = F.expr("CASE pair " + " ".join(f"WHEN {i} THEN {x.where}" for i, x in enumerate(doubles)) + " END")
        op = F.expr(chosen("op", "pair", texts["op"]).rpartition(" AS ")[0])
        met = either_join(first, second, op, Temporal("Bef", F.col("delta"), zeta=F.col("zeta"), rho=F.col("rho")),
                          Temporal("SP", F.col("delta"), zeta=F.col("zeta"), rho=F.col("rho")),
                          on=[("analysis_id", "n_id"), ("pair", "n_pair"), ("same", "n_same")],
                          left_bounds=("m_s", "m_e"), right_bounds=("n_s", "n_e"), where=where)
        slots = [[*x.args, "NULL", "NULL", "NULL"][:3] for x in doubles]
        found.append(met.selectExpr(
            "setting", "analysis_id", chosen("event_id", "pair", texts["event"]), chosen("modality", "pair", texts["modality"]),
            *[f"CAST({chosen(a, 'pair', [s[k] for s in slots]).rpartition(' AS ')[0]} AS INT) AS {a}" for k, a in enumerate(ARGS)],
            "m_s AS sf", "n_e AS ef"))
    return reduce(DataFrame.union, found)


def detect_all(visual: DataFrame, audio: DataFrame, thresholds: Thresholds = Thresholds(),
               conditions: Sequence[str] = CONDITIONS, events: Sequence[str] = EVENTS) -> DataFrame:
    """Every event in every recording under every condition, as one long table.

    All events are detected in one pass over the two tables (``detect_by_rows``).  The rows
    then pass one rebalancing exchange that both readers share: A and B take them as they
    are, C takes their distinct union.
    """
    parameters = parameters_of({"": thresholds}, visual.sparkSession)
    found = detect_by_rows(visual, audio, parameters, thresholds, events).drop("setting").hint("rebalance")

    def under(choices: dict[str, str]) -> str:
        """The conditions a row belongs to.  An outer explode with the filter behind
        it, since a filter in front would differ between the readers and undo the sharing."""
        cases = " ".join(f"WHEN {when} THEN array({then})" for when, then in choices.items())
        return f"explode_outer(CASE {cases} ELSE CAST(array() AS array<string>) END) AS condition"

    def wanted(letters: str) -> str:
        return ", ".join(f"'{c}'" for c in letters if c in conditions)

    heard = "event_id IN ({})".format(", ".join(f"'{e}'" for e in _AUDIO))
    single = found.selectExpr("*", under({
        "modality = 'audio'": wanted("B"), heard: wanted("A"), "true": wanted("AC")}))
    both = found.distinct().selectExpr("*", under({heard: wanted("C")}))
    return single.union(both).where("condition IS NOT NULL")


def detected_conditions(visual: DataFrame, audio: DataFrame, thresholds: Thresholds = Thresholds(),
                        events: Sequence[str] = EVENTS) -> DataFrame:
    """analysis_id, event_id, condition: what ``detect_all`` finds at least once, each once.

    Detections fold to their event right behind the join, so no later step holds them.
    """
    parameters = parameters_of({"": thresholds}, visual.sparkSession)
    found = detect_by_rows(visual, audio, parameters, thresholds, events).select("analysis_id", "event_id", "modality").distinct()
    return found.selectExpr("analysis_id", "event_id", "explode(CASE modality WHEN 'audio' THEN array('B', 'C') "
                                                       "ELSE array('A', 'C') END) AS condition").distinct()
