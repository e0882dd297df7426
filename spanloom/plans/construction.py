"""Building intervals and windows from observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import time as ft
from spanloom.operators import islands
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views

registry = Registry()


@registry.query(with_views("relations") + """
    SELECT analysis_id, frame, relation_id, relation_type,
           array_to_string(list_sort(list_distinct(list(class_id))), ',') AS participants
    FROM relations GROUP BY 1, 2, 3, 4""")
def participants_per_relation(v: Views):
    return islands.participant_sets(v.relations).withColumn(
        "participants", F.array_join(F.col("participants").cast("array<string>"), ","))


def collapse_sql(source: str, keys: str, gap: int) -> str:
    """Gaps and islands over distinct frames, as one plain window query."""
    return f"""d AS (SELECT DISTINCT {keys}, frame FROM {source}),
      g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY {keys} ORDER BY frame) <= {gap}
              THEN 0 ELSE 1 END AS f FROM d),
      n AS (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY frame) AS island FROM g),
      intervals AS (SELECT {keys}, min(frame) AS start_frame, max(frame) AS end_frame FROM n
              GROUP BY {keys}, island)"""


@registry.query(with_views("frame_rel") + ", " + collapse_sql(
    "frame_rel", "analysis_id, relation_type, class_id", 48) + " SELECT * FROM intervals")
def frames_to_intervals(v: Views):
    return islands.frames_to_intervals(v.frame_rel, 24, ("analysis_id", "relation_type", "class_id"))


@registry.query(with_views("relations") + """,
    s AS (SELECT analysis_id, frame, relation_id, relation_type,
            array_to_string(list_sort(list_distinct(list(class_id))), ',') AS participants
          FROM relations GROUP BY 1, 2, 3, 4), """ + collapse_sql(
    "s", "analysis_id, relation_type, participants", 2) + " SELECT * FROM intervals")
def participant_intervals(v: Views):
    """Participant sets per frame, then collapsed; sampling rate 1."""
    rows = islands.frames_to_intervals(islands.participant_sets(v.relations), 1)
    return rows.withColumn("participants",
                           F.array_join(F.col("participants").cast("array<string>"), ","))


def coalesce_sql(source: str, keys: str, gap: int) -> str:
    return coalesced_sql(source, keys, gap) + " SELECT * FROM intervals"


def coalesced_sql(source: str, keys: str, gap: int) -> str:
    return f"""m AS (SELECT *, max(ef) OVER (PARTITION BY {keys} ORDER BY sf, ef, confidence
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
      n AS (SELECT *, sum(CASE WHEN sf <= reach + {gap} THEN 0 ELSE 1 END) OVER (
              PARTITION BY {keys} ORDER BY sf, ef, confidence ROWS UNBOUNDED PRECEDING) AS island FROM m),
      intervals AS (SELECT {keys}, min(sf) AS start_frame, max(ef) AS end_frame, max(confidence) AS confidence
      FROM n GROUP BY {keys}, island)"""


def _predictions(v: Views):
    return v.audio.select("analysis_id", "audio_class", F.col("sf").alias("start_frame"),
                          F.col("ef").alias("end_frame"), "confidence")


@registry.query(with_views("frame_rel") + ", " + collapse_sql(
    "frame_rel", "analysis_id, relation_type, class_id", "2 * (analysis_id % 3 + 1) * 8") + " SELECT * FROM intervals")
def frames_to_intervals_own_rates(v: Views):
    """Recordings of three sampling rates in one job."""
    rows = v.frame_rel.withColumn("rate", (F.col("analysis_id") % 3 + 1) * 8)
    return islands.frames_to_intervals(rows, "rate", ("analysis_id", "relation_type", "class_id"))


@registry.query(with_views("api") + ", " + coalesce_sql("api", "analysis_id, audio_class", "(analysis_id % 3) * 30"))
def coalesce_audio_own_hops(v: Views):
    """Recordings of three hops, among them none, in one job."""
    return islands.coalesce_audio(_predictions(v).withColumn("hop", (F.col("analysis_id") % 3) * 30), "hop")


@registry.query(with_views("iv") + """, c AS (SELECT analysis_id, pred, sf / 4.0 AS sf, ef / 4.0 AS ef, 0.0 AS confidence FROM iv),
    x AS (WITH """ + coalesce_sql("c", "analysis_id, pred", 1)
                + ") SELECT analysis_id, pred, start_frame AS sf, end_frame AS ef FROM x")
def coalesce_real_times(v: Views):
    """Starts and ends in seconds, so real numbers."""
    rows = v.iv.select("analysis_id", "pred", (F.col("sf") / 4).alias("sf"), (F.col("ef") / 4).alias("ef"))
    return islands.merge_close(rows, ["analysis_id", "pred"], "sf", "ef", 1)


@registry.query(with_views("api") + ", " + coalesce_sql("api", "analysis_id, audio_class", 60))
def coalesce_audio(v: Views):
    return islands.coalesce_audio(_predictions(v), 60)


@registry.query(with_views("iv") + """, c AS (SELECT *, 0.0 AS confidence FROM iv),
    x AS (WITH """ + coalesce_sql("c", "analysis_id, pred", 30)
                + ") SELECT analysis_id, pred, start_frame AS sf, end_frame AS ef FROM x")
def coalesce_intervals(v: Views):
    return islands.merge_close(v.iv, ["analysis_id", "pred"], "sf", "ef", 30)


@registry.query("""
    WITH r AS (SELECT p_partkey AS analysis_id, CAST(p_size AS BIGINT) * 12000 AS samples,
                 CAST(p_size % 4 * 6 + 12 AS INT) AS fps FROM part),
      w AS (SELECT analysis_id, fps, samples, unnest(range(0, greatest(samples - 80000, 0) + 1, 40000)) AS window_start FROM r),
      e AS (SELECT *, least(window_start + 80000, samples) AS window_end FROM w)
    SELECT analysis_id, window_start, window_end,
      CAST(trunc(window_start / 16000 * fps) AS BIGINT) AS start_frame,
      CAST(trunc(window_end / 16000 * fps) AS BIGINT) AS end_frame
    FROM e WHERE window_end - window_start >= 8000""")
def sliding_windows(v: Views):
    """5 s windows with 2.5 s hop over recordings of 16 kHz sound."""
    recordings = v.table("part").select(
        F.col("p_partkey").alias("analysis_id"),
        (F.col("p_size").cast("long") * 12000).alias("samples"),
        (F.col("p_size") % 4 * 6 + 12).alias("fps"))
    return islands.analysis_windows(recordings, F.col("samples"), 16000, F.col("fps"), 5.0, 2.5).select(
        "analysis_id", "window_start", "window_end", "start_frame", "end_frame")


_WINDOWS = """,
    m AS (SELECT analysis_id, event_type AS label, value AS score, frame,
            unnest(range(CAST(greatest((frame - 6) // 3 + 1, 0) AS BIGINT), frame // 3 + 1)) * 3 AS window_start
          FROM observed WHERE frame >= 6
          UNION ALL SELECT analysis_id, event_type, value, frame,
            unnest(range(0, frame // 3 + 1)) * 3 FROM observed WHERE frame < 6)"""


@registry.query(with_views("observed") + _WINDOWS + """
    SELECT analysis_id, window_start, window_start + 6 AS window_end, count(*) AS n,
           round(sum(score), 4) AS total FROM m GROUP BY analysis_id, window_start""")
def window_membership(v: Views):
    """Scores in 6-hour windows every 3 hours."""
    return islands.assign_windows(v.observed, "frame", 6, 3).groupBy(
        "analysis_id", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registry.query(with_views("observed") + _WINDOWS + """
    SELECT analysis_id, window_start, window_end, label, score FROM (
      SELECT analysis_id, window_start, window_start + 6 AS window_end, label, score,
        row_number() OVER (PARTITION BY analysis_id, window_start ORDER BY score DESC, label) AS rn FROM m)
    WHERE rn = 1 AND score >= 20.0""")
def top_label_per_window(v: Views):
    rows = islands.assign_windows(v.observed, "frame", 6, 3).withColumnsRenamed(
        {"event_type": "label", "value": "score"})
    return islands.top_label(rows, ["analysis_id", "window_start", "window_end"], floor=20.0)


@registry.query(with_views("observed") + _WINDOWS + """,
    t AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, window_start ORDER BY score DESC, label)
            AS rn FROM m),
    y AS (SELECT analysis_id, label AS audio_class, window_start AS sf, window_start + 6 AS ef,
            score AS confidence FROM t WHERE rn = 1),
    u AS (SELECT *, max(ef) OVER (PARTITION BY analysis_id, audio_class ORDER BY sf
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y),
    n AS (SELECT *, sum(CASE WHEN sf <= reach + 3 THEN 0 ELSE 1 END) OVER (
            PARTITION BY analysis_id, audio_class ORDER BY sf ROWS UNBOUNDED PRECEDING) AS island FROM u)
    SELECT analysis_id, audio_class, min(sf) AS start_frame, max(ef) AS end_frame,
           max(confidence) AS confidence FROM n GROUP BY analysis_id, audio_class, island""")
def windows_to_intervals(v: Views):
    """Scores to windows, best label each, touching windows of one label merged."""
    rows = islands.assign_windows(v.observed, "frame", 6, 3).withColumnsRenamed(
        {"event_type": "label", "value": "score"})
    best = islands.top_label(rows, ["analysis_id", "window_start", "window_end"])
    return islands.coalesce_audio(best.select(
        "analysis_id", F.col("label").alias("audio_class"), F.col("window_start").alias("start_frame"),
        F.col("window_end").alias("end_frame"), F.col("score").alias("confidence")), 3)


@registry.query(with_views("observed") + """
    SELECT analysis_id, user_id AS class_id, max_by(event_type, (frame, event_type)) AS class
    FROM observed GROUP BY 1, 2""")
def class_of_object(v: Views):
    return islands.class_map(v.observed.select(
        "analysis_id", F.col("user_id").alias("class_id"), "frame", F.col("event_type").alias("class")))


@registry.query(with_views("frame_rel") + """
    SELECT *, frame - lag(frame) OVER (PARTITION BY analysis_id, relation_type, class_id ORDER BY frame)
      AS gap FROM frame_rel""")
def gap_to_previous(v: Views):
    return islands.gap_to_previous(v.frame_rel, ["analysis_id", "relation_type", "class_id"],
                                   "frame", "gap")


@registry.query(with_views("iv") + """,
    d AS (SELECT analysis_id, pred, sf, max(ef) AS ef FROM iv GROUP BY 1, 2, 3)
    SELECT *, max(ef) OVER (PARTITION BY analysis_id, pred ORDER BY sf
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d""")
def running_end(v: Views):
    rows = v.iv.groupBy("analysis_id", "pred", "sf").agg(F.max("ef").alias("ef"))
    return islands.running_end(rows, ["analysis_id", "pred"], "sf", "ef", "reach")


# -- scalar functions ----------------------------------------------------------

@registry.query(with_views("iv", "runs") + """
    SELECT i.analysis_id, i.arg2, i.sf, CAST(round_even(i.ef / 20.0 * r.fps, 0) AS BIGINT) AS rounded,
      CAST(trunc(i.sf / 7.0 * r.fps) AS BIGINT) AS truncated, i.ef - i.sf AS length,
      i.ef - i.sf + 1 AS size, printf('%d:%05.2f', i.sf // 60, CAST(i.sf % 60 AS DOUBLE)) AS clock
    FROM iv i JOIN runs r USING (analysis_id) WHERE i.sf < 3600
    UNION ALL SELECT i.analysis_id, i.arg2, i.sf, CAST(round_even(i.ef / 20.0 * r.fps, 0) AS BIGINT),
      CAST(trunc(i.sf / 7.0 * r.fps) AS BIGINT), i.ef - i.sf, i.ef - i.sf + 1,
      printf('%d:%02d:%05.2f', i.sf // 3600, i.sf % 3600 // 60, CAST(i.sf % 60 AS DOUBLE))
    FROM iv i JOIN runs r USING (analysis_id) WHERE i.sf >= 3600""")
def frame_arithmetic(v: Views):
    rows = v.iv.join(v.runs, "analysis_id")
    sf, ef, fps = F.col("sf"), F.col("ef"), F.col("fps")
    return rows.select(
        "analysis_id", "arg2", "sf", ft.seconds_to_frames(ef / 20.0, fps).alias("rounded"),
        ft.truncate_frames(sf / 7.0 * fps).alias("truncated"),
        ft.interval_length(sf, ef).alias("length"), ft.interval_size(sf, ef).alias("size"),
        ft.clock_text(sf.cast("double")).alias("clock"))


@registry.query(with_views("runs") + """
    SELECT analysis_id, rate, CASE WHEN rate LIKE '%/0' THEN 24 ELSE fps END AS parsed FROM runs""")
def frame_rate_text(v: Views):
    return v.runs.select("analysis_id", "rate", ft.frame_rate(F.col("rate"), F.lit("0/0")).alias("parsed"))


@registry.query(with_views("iv") + """
    SELECT analysis_id, arg2, sf, pred || '_' || CAST(sf AS VARCHAR) AS token,
      CASE WHEN sf % 3 = 0 THEN NULL ELSE CAST(sf AS INT) END AS threshold FROM iv""")
def unbounded_token(v: Views):
    text = F.when(F.col("sf") % 6 == 0, "inf").when(F.col("sf") % 3 == 0, "∞").otherwise(
        F.col("sf").cast("string"))
    return v.iv.select("analysis_id", "arg2", "sf",
                       F.concat("pred", F.lit("_"), F.col("sf").cast("string")).alias("token"),
                       ft.unbounded(text).alias("threshold"))
