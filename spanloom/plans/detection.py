"""Selections, the canonical events, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.time import clock_text
from spanloom.operators import setops
from spanloom.operators.chain import Duration, chain
from spanloom.operators.select import (
    any_of, attach_participants, pick, route_by_taxonomy, select_intervals, split_valid, with_seconds,
)
from spanloom.operators.thresholds import operator_rows, resolve
from spanloom.plans.events import PAIRS, Thresholds, detect, detect_all, detect_by_rows, parameters_of
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views
from spanloom.vocab import AUDIO_CLASSES, EVENTS

registry = Registry()
FPS = 24

# -- selections --------------------------------------------------------------


@registry.query(with_views("iv") + "SELECT * FROM iv WHERE pred = 'A'")
def select_label(v: Views):
    return v.iv.where(F.col("pred") == "A")


def _doubtful(v: Views):
    """Intervals whose end is moved, so that some end before they start or have no end."""
    return v.iv.withColumn("ef", F.when(F.col("arg2") % 9 != 0, F.col("ef") - 12))


_DOUBTFUL = with_views("iv") + """, d AS (SELECT analysis_id, pred, arg1, arg2, sf,
    CASE WHEN arg2 % 9 <> 0 THEN ef - 12 END AS ef FROM iv)"""


@registry.query(_DOUBTFUL + " SELECT * FROM d WHERE sf <= ef")
def valid_intervals(v: Views):
    return split_valid(_doubtful(v))[0]


@registry.query(_DOUBTFUL + " SELECT * FROM d WHERE ef IS NULL OR sf > ef")
def rejected_intervals(v: Views):
    return split_valid(_doubtful(v))[1]


@registry.query(with_views("vpi") + """
    SELECT analysis_id, sf, ef FROM vpi WHERE relation_type IN ('running', 'carrying')""")
def select_labels(v: Views):
    return select_intervals(pick("running", "carrying", "running"), v.visual, v.audio)


@registry.query(with_views("who") + """
    SELECT analysis_id, arg1, sf, ef FROM who
    WHERE (relation_type = 'gunshot_visible' AND class1 = 'person')
       OR (relation_type = 'explosion_visible' AND class1 IN ('vehicle', 'object'))""")
def select_branches(v: Views):
    chosen = any_of(pick("gunshot_visible", arg1="person"),
                    pick("explosion_visible", arg1=("vehicle", "object")))
    return select_intervals(chosen, v.visual, v.audio)


@registry.query(with_views("whose") + """
    SELECT analysis_id, arg1, arg2, sf, ef FROM whose
    WHERE relation_type = 'carrying' AND class1 = 'person' AND class2 IN ('object', 'vehicle')""")
def select_participant_classes(v: Views):
    return select_intervals(pick("carrying", arg1="person", arg2=("object", "vehicle")),
                            v.visual, v.audio)


@registry.query(with_views("who") + """
    SELECT analysis_id, arg1, count(*) AS n, sum(ef - sf) AS frames FROM who
    WHERE relation_type = 'running' AND class1 = 'person' GROUP BY 1, 2""")
def select_from_child_table(v: Views):
    """Participants kept in a table of their own are nested into their intervals, then selected."""
    keyed = v.visual.withColumn("relation_id", F.struct("analysis_id", "relation_type", "sf", "ef", "participants"))
    children = keyed.select("relation_id", F.explode("participants").alias("p")).select("relation_id", "p.*").distinct()
    rows = attach_participants(keyed.drop("participants"), children)
    return select_intervals(pick("running", arg1="person"), rows, v.audio).groupBy("analysis_id", "arg1").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ef") - F.col("sf")).alias("frames"))


@registry.query(with_views("vpi", "api") + f"""
    SELECT label, source, count(*) AS n FROM (
      SELECT relation_type AS label, CASE WHEN relation_type IN {tuple(AUDIO_CLASSES)} THEN 'audio'
        ELSE 'visual' END AS source FROM vpi
      UNION ALL SELECT audio_class, CASE WHEN audio_class IN {tuple(AUDIO_CLASSES)} THEN 'audio'
        ELSE 'visual' END FROM api) GROUP BY ALL""")
def route_labels(v: Views):
    labels = v.visual.select(F.col("relation_type").alias("label")).union(
        v.audio.select("audio_class"))
    taxonomy = v.literals([(c,) for c in AUDIO_CLASSES], "audio_class string")
    return route_by_taxonomy(labels, taxonomy).groupBy("label", "source").agg(
        F.count(F.lit(1)).alias("n"))


@registry.query(with_views("api") + """
    SELECT analysis_id, CAST(NULL AS INT) AS arg1, sf, ef FROM api
    WHERE audio_class IN ('shout', 'impact') AND confidence >= 0.95""")
def select_audio(v: Views):
    """Audio rows have no participants: the slot is NULL whatever class it names."""
    return select_intervals(pick("shout", "impact", arg1="person"), v.visual, v.audio,
                            min_confidence=0.95)


@registry.query(with_views("iv", "runs") + """
    SELECT i.analysis_id, i.arg2, i.sf, i.ef, round(CAST(i.sf AS DOUBLE) / greatest(r.fps, 1), 6) AS st,
           round(CAST(i.ef AS DOUBLE) / greatest(r.fps, 1), 6) AS et
    FROM iv i JOIN runs r USING (analysis_id)""")
def time_domain(v: Views):
    rows = with_seconds(v.iv.join(v.runs, "analysis_id"), F.col("fps"))
    return rows.select("analysis_id", "arg2", "sf", "ef", F.round("st", 6).alias("st"),
                       F.round("et", 6).alias("et"))


@registry.query(with_views("vpi") + """
    SELECT analysis_id, sf AS M1_sf, ef AS M1_ef FROM vpi
    WHERE relation_type = 'running' AND ef - sf >= 150""")
def minimum_duration(v: Views):
    return chain([select_intervals(pick("running"), v.visual, v.audio)], (),
                 [Duration("M1", "M1", ">=", 150)])


# -- events ------------------------------------------------------------------

_HEAD = "SELECT {a} AS analysis_id, '{e}' AS event_id, '{m}' AS modality, {args}, {s} AS sf, {t} AS ef"


def _head(event: str, modality: str, a: str, args: list[str], s: str, t: str) -> str:
    slots = [f"CAST({x} AS INT) AS arg{i}" for i, x in enumerate((args + ["NULL"] * 3)[:3], 1)]
    return _HEAD.format(a=a, e=event, m=modality, args=", ".join(slots), s=s, t=t)


def _audio_pair(event: str, first: str, second: str, condition: str) -> str:
    return (_head(event, "audio", "r.analysis_id", [], "r.sf", "s.ef") + f"""
        FROM api r JOIN api s ON r.analysis_id = s.analysis_id
        WHERE r.audio_class IN ({first}) AND s.audio_class IN ({second}) AND {condition}""")


_ONE, _TWO = "FROM who i", "FROM whose i"
EVENT_SQL = {
    ("fight", "A"): _head("fight", "visual", "i.analysis_id", ["i.arg1", "i.arg2"], "i.sf", "i.ef")
    + f""" {_TWO} WHERE i.relation_type = 'physical_altercation' AND i.class1 = 'person'
        AND i.class2 = 'person' AND i.arg1 <> i.arg2""",
    ("fight", "B"): _audio_pair("fight", "'shout'", "'impact'", "r.ef <= s.sf AND s.sf - r.ef <= 120"),
    ("gunshot_or_explosion", "A"): _head("gunshot_or_explosion", "visual", "i.analysis_id",
                                         ["i.arg1"], "i.sf", "i.ef")
    + f""" {_ONE} WHERE (i.relation_type = 'gunshot_visible' AND i.class1 = 'person')
        OR (i.relation_type = 'explosion_visible' AND i.class1 IN ('vehicle', 'object'))""",
    ("gunshot_or_explosion", "B"): _head("gunshot_or_explosion", "audio", "i.analysis_id", [], "i.sf", "i.ef")
    + " FROM api i WHERE i.audio_class = 'gunshot_or_explosion'",
    ("handoff", "A"): """, carry AS (SELECT analysis_id, arg1, arg2, sf, ef FROM whose i
        WHERE i.relation_type = 'carrying' AND i.class1 = 'person' AND i.class2 = 'object') """
    + _head("handoff", "visual", "r.analysis_id", ["r.arg1", "s.arg1", "r.arg2"], "r.sf", "s.ef")
    + """ FROM carry r JOIN carry s ON r.analysis_id = s.analysis_id AND r.arg2 = s.arg2
        WHERE r.arg1 <> s.arg1 AND r.ef <= s.sf""",
    ("suspicious_near_vehicle", "A"): _head("suspicious_near_vehicle", "visual", "i.analysis_id",
                                            ["i.arg1", "i.arg2"], "i.sf", "i.ef")
    + f""" {_TWO} WHERE i.relation_type = 'suspicious_near_vehicle' AND i.class1 = 'person'
        AND i.class2 = 'vehicle' AND i.ef - i.sf >= 72""",
    ("vehicle_collision", "A"): _head("vehicle_collision", "visual", "i.analysis_id", ["i.arg1"],
                                      "i.sf", "i.ef")
    + f" {_ONE} WHERE i.relation_type = 'vehicle_collision' AND i.class1 = 'vehicle'",
    ("vehicle_collision", "B"): _audio_pair("vehicle_collision", "'horn', 'skidding'",
                                            "'impact', 'glass_breaking'", "r.sf <= s.sf AND s.sf < r.ef"),
    ("vehicle_escape", "A"): """, run AS (SELECT analysis_id, arg1, sf, ef FROM who i
        WHERE i.relation_type = 'running' AND i.class1 = 'person'),
      enter AS (SELECT analysis_id, arg1, arg2, sf, ef FROM whose i
        WHERE i.relation_type = 'enter_or_exit_vehicle' AND i.class1 = 'person' AND i.class2 = 'vehicle') """
    + _head("vehicle_escape", "visual", "r.analysis_id", ["r.arg1", "s.arg2"], "r.sf", "s.ef")
    + """ FROM run r JOIN enter s ON r.analysis_id = s.analysis_id AND r.arg1 = s.arg1
        WHERE r.ef <= s.sf AND s.sf - r.ef <= 48""",
    ("vehicle_escape", "B"): _audio_pair("vehicle_escape", "'engine'", "'tire_squeal'",
                                         "r.sf <= s.sf AND s.sf < r.ef"),
}
_BASE = with_views("whose", "api")


def _event_sql(event: str, condition: str) -> str:
    """The full statement of one event; a leading comma in the text continues the CTEs."""
    if (event, "B") not in EVENT_SQL:
        return _BASE + EVENT_SQL[(event, "A")]
    if condition != "C":
        return _BASE + EVENT_SQL[(event, condition)]
    visual, audio = EVENT_SQL[(event, "A")], EVENT_SQL[(event, "B")]
    ctes, _, select = visual.rpartition(") SELECT ") if visual.startswith(",") else ("", "", visual)
    if ctes:
        return f"{_BASE}{ctes}) (SELECT {select}) UNION ({audio})"
    return f"{_BASE} ({select}) UNION ({audio})"


for _event in EVENTS:
    for _condition in "ABC":
        if (_event, "B") not in EVENT_SQL and _condition != "A":
            continue
        registry.add(
            f"event_{_event}_{_condition.lower()}",
            lambda v, e=_event, c=_condition: detect(e, c, v.visual, v.audio, Thresholds(fps=FPS)),
            _event_sql(_event, _condition))


def _all_sql() -> str:
    """Every event under every condition as one union."""
    ctes, parts = [], []
    for event in EVENTS:
        for modality in "AB":
            text = EVENT_SQL.get((event, modality))
            if text is None:
                continue
            name = f"d_{event}_{modality.lower()}"
            if text.startswith(","):
                extra, _, select = text.rpartition(") SELECT ")
                ctes.append(extra.lstrip(", ") + ")")
                text = "SELECT " + select
            ctes.append(f"{name} AS ({text})")
            parts.append(f"SELECT *, '{modality}' AS condition FROM {name}")
        if (event, "B") in EVENT_SQL:
            parts.append(f"SELECT *, 'C' AS condition FROM (SELECT * FROM d_{event}_a UNION "
                         f"SELECT * FROM d_{event}_b)")
        else:
            parts.append(f"SELECT *, 'C' AS condition FROM d_{event}_a")
    return _BASE + ",\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


ALL_SQL = _all_sql()
registry.add("detect_all_events",
             lambda v: detect_all(v.visual, v.audio, Thresholds(fps=FPS)), ALL_SQL)


_TOLERANCE = 2  # frames


def _tolerant(text: str) -> str:
    """The same event with every bound loosened."""
    for strict, loose in (("r.ef <= s.sf", f"r.ef <= s.sf + {_TOLERANCE}"), ("s.sf - r.ef <= 120", f"s.sf - r.ef <= {120 + _TOLERANCE}"),
                          ("s.sf - r.ef <= 48", f"s.sf - r.ef <= {48 + _TOLERANCE}"),
                          ("r.sf <= s.sf AND s.sf < r.ef", f"r.sf - {_TOLERANCE} <= s.sf AND s.sf < r.ef + {_TOLERANCE}")):
        text = text.replace(strict, loose)
    return text


def _settings_sql() -> str:
    ctes, parts = [], []
    for setting, change in (("authored", lambda x: x), ("tolerant", _tolerant)):
        for (event, modality), text in EVENT_SQL.items():
            text = change(text)
            if text.startswith(","):
                extra, _, select = text.rpartition(") SELECT ")
                if setting == "authored":
                    ctes.append(extra.lstrip(", ") + ")")
                text = "SELECT " + select
            parts.append(f"SELECT '{setting}' AS setting, * FROM ({text})")
    return _BASE + ",\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


@registry.query(_settings_sql())
def detect_two_settings(v: Views):
    """All events under two settings, whose parameters are rows of a table, in one job."""
    base = Thresholds(fps=FPS)
    settings = {"authored": base, "tolerant": base.everywhere(rho=_TOLERANCE / FPS)}
    return detect_by_rows(v.visual, v.audio, parameters_of(settings, v.spark), base)


@registry.query(_BASE + "," + ",".join(x.rpartition(") SELECT ")[0].lstrip(", ") + ")" for x in EVENT_SQL.values() if x.startswith(","))
                + " " + " UNION ALL ".join("SELECT 'stored' AS setting, * FROM (" + (
                    "SELECT " + x.rpartition(") SELECT ")[2] if x.startswith(",") else x).replace("<= 120", "<= 240") + ")"
                    for x in EVENT_SQL.values()))
def detect_resolved_parameters(v: Views):
    """From authored literals over defaults to typed rows, and from these to detections, in one job."""
    names = [f"{kind}_{m}_{e}" for e, m in PAIRS for kind in ("delta", "zeta", "rho")]
    spec = v.literals([(n, n.partition("_")[0]) for n in names], "name string, key_kind string")
    authored = v.literals([("delta_audio_fight", "10"), ("delta_visual_vehicle_escape", "2"), ("zeta_visual_handoff", "<=")],
                          "name string, literal string")
    values = spec.join(authored, "name", "left").select("name", "key_kind", F.coalesce(
        "literal", F.when(F.col("key_kind") == "delta", "inf").when(F.col("key_kind") == "zeta", "<=").otherwise("0")).alias("value"))
    rows = operator_rows(resolve(values).withColumn("setting", F.lit("stored")), scale=F.lit(FPS))
    return detect_by_rows(v.visual, v.audio, rows, Thresholds(fps=FPS))


# The seconds domain with each recording's own frame rate.
@registry.query(with_views("whose", "runs") + """,
    t AS (SELECT w.*, CAST(sf AS DOUBLE) / fps AS st, CAST(ef AS DOUBLE) / fps AS et FROM who w JOIN runs USING (analysis_id)
      WHERE relation_type = 'running' AND class1 = 'person'),
    e AS (SELECT w.*, CAST(sf AS DOUBLE) / fps AS st, CAST(ef AS DOUBLE) / fps AS et FROM whose w JOIN runs USING (analysis_id)
      WHERE relation_type = 'enter_or_exit_vehicle' AND class1 = 'person' AND class2 = 'vehicle')
    SELECT m.analysis_id, m.arg1, n.arg2, round(m.st, 6) AS st, round(n.et, 6) AS et
    FROM t m JOIN e n ON m.analysis_id = n.analysis_id AND m.arg1 = n.arg1 WHERE m.et <= n.st AND n.st - m.et <= 2""")
def event_vehicle_escape_seconds(v: Views):
    visual = with_seconds(v.visual.join(v.runs.select("analysis_id", "fps"), "analysis_id"),
                          F.col("fps"))
    audio = with_seconds(v.audio.join(v.runs.select("analysis_id", "fps"), "analysis_id"),
                         F.col("fps"))
    rows = detect("vehicle_escape", "A", visual, audio,
                  Thresholds(fps=1, bounds=("st", "et")))
    return rows.select("analysis_id", "arg1", "arg2", F.round("sf", 6).alias("st"),
                       F.round("ef", 6).alias("et"))


_E = EVENT_SQL[("vehicle_escape", "B")]


@registry.query(_BASE + f""", ev AS ({_E})
    SELECT r.analysis_id, r.sf AS M1_sf, r.ef AS M1_ef, s.sf AS M2_sf, s.ef AS M2_ef
    FROM ev r JOIN api s ON r.analysis_id = s.analysis_id
    WHERE s.audio_class = 'impact' AND r.ef <= s.sf AND s.sf - r.ef <= 240""")
def event_inside_event(v: Views):
    """A detected event is itself an interval of an outer chain."""
    from spanloom.operators.temporal import Temporal

    inner = detect("vehicle_escape", "B", v.visual, v.audio, Thresholds(fps=FPS)).select(
        "analysis_id", "sf", "ef")
    impact = select_intervals(pick("impact"), v.visual, v.audio)
    return chain([inner, impact], [Temporal("Bef", delta=240)])


@registry.query(_BASE + f""", ev AS ({_E})
    SELECT analysis_id, sf, ef, CASE WHEN sf // 86400 > 0 THEN
        printf('%d:%02d:%05.2f', sf // 86400, (sf % 86400) // 1440, (sf % 1440) / 24.0)
        ELSE printf('%d:%05.2f', sf // 1440, (sf % 1440) / 24.0) END AS start_text FROM ev""")
def event_clock_text(v: Views):
    rows = detect("vehicle_escape", "B", v.visual, v.audio, Thresholds(fps=FPS))
    return rows.select("analysis_id", "sf", "ef",
                       clock_text(F.col("sf").cast("double") / FPS).alias("start_text"))


# -- set operations ------------------------------------------------------------

def _sides(v: Views):
    left = v.iv.where("pred = 'A'").select("analysis_id", "arg1", "sf")
    right = v.iv.where("pred = 'R'").select("analysis_id", "sf")
    return left, right


def _set_sql(keyword: str) -> str:
    return with_views("iv") + f"""
        SELECT analysis_id, arg1, sf FROM iv WHERE pred = 'A' {keyword}
        SELECT analysis_id, NULL, sf FROM iv WHERE pred = 'R'"""


@registry.query(_set_sql("UNION"))
def union_padded(v: Views):
    return setops.union(*_sides(v))


@registry.query(with_views("iv") + """SELECT analysis_id, arg1 FROM iv WHERE pred = 'A'
    EXCEPT SELECT analysis_id, arg1 FROM iv WHERE pred = 'R'""")
def difference_distinct(v: Views):
    a, r = (v.iv.where(F.col("pred") == p).select("analysis_id", "arg1") for p in "AR")
    return setops.difference(a, r)


@registry.query(with_views("iv") + """SELECT analysis_id, arg1 FROM iv WHERE pred = 'A'
    INTERSECT SELECT analysis_id, arg1 FROM iv WHERE pred = 'R'""")
def intersection_distinct(v: Views):
    a, r = (v.iv.where(F.col("pred") == p).select("analysis_id", "arg1") for p in "AR")
    return setops.intersection(a, r)


@registry.query(with_views("iv") + """
    SELECT analysis_id, arg1, sf FROM iv WHERE pred = 'A' UNION
    SELECT analysis_id, sf, NULL FROM iv WHERE pred = 'R'""")
def union_positional(v: Views):
    return setops.positional_union(*_sides(v))


@registry.query(with_views("iv") + """
    SELECT analysis_id, sf, NULL AS sf2 FROM iv WHERE pred = 'R' EXCEPT
    SELECT analysis_id, arg1, sf FROM iv WHERE pred = 'A'""")
def difference_positional(v: Views):
    """The right side is the wider one."""
    wide, slim = _sides(v)
    return setops.positional_difference(slim, wide).toDF("analysis_id", "sf", "sf2")


@registry.query(with_views("iv") + """
    SELECT analysis_id, sf FROM iv WHERE pred = 'A' INTERSECT SELECT analysis_id, sf FROM iv WHERE pred = 'R'""")
def intersection_positional(v: Views):
    a, r = (v.iv.where(F.col("pred") == p).select("analysis_id", F.col("sf").alias(n)) for p, n in (("A", "sf"), ("R", "x")))
    return setops.positional_intersection(a, r)


@registry.query(with_views("vpi", "api") + """
    SELECT analysis_id, sf, ef, 'visual' AS modality FROM vpi WHERE relation_type = 'vehicle_collision'
      AND ef - sf >= 100
    UNION SELECT analysis_id, sf, ef, 'audio' FROM api WHERE audio_class = 'impact'
      AND ef - sf <= 20""")
def union_multimodal(v: Views):
    """Each side keeps its own condition before the union."""
    seen = select_intervals(pick("vehicle_collision"), v.visual, v.audio).where("ef - sf >= 100")
    heard = select_intervals(pick("impact"), v.visual, v.audio).where("ef - sf <= 20")
    return setops.multimodal_union(seen, heard)
