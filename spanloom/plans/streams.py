"""Streaming twins, run over the tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.plans.construction import coalesced_sql, collapse_sql
from spanloom.plans.joins import predicate_sql
from spanloom.plans.registry import Registry
from spanloom.plans.similar import SIMILAR_SQL, TRACKED_SQL
from spanloom.plans.views import Views, with_views
from spanloom.streaming.identity import stream_track, stream_track_similar
from spanloom.streaming.intervals import stream_before, stream_coalesce_audio, stream_intervals
from spanloom.streaming.run import drain

registry = Registry()


# Recordings begin a day after another, the first one after the epoch, where a stream's watermark stands before its
# first batch and what is not later counts as late; rows of one may come so late.
FPS, LATE_FRAMES = 25, 100
LATENESS = f"{LATE_FRAMES // FPS} seconds"


def started():
    return F.timestamp_seconds((F.col("analysis_id").cast("long") + 1) * 86400)


class StreamViews(Views):
    """The same views over streamed files."""

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        # A stream reads a folder or a pattern, and the table is one file.
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def closed_sql(intervals: str, rows: str, end: str, gap: int, start: str) -> str:
    """Given out are all intervals of recordings that the stream has left behind, and of the last what its own rows have."""
    return f""" SELECT i.* FROM {intervals} i JOIN (SELECT analysis_id, max({start}) AS reached FROM {rows} GROUP BY 1) r
      USING (analysis_id) WHERE i.{end} + {gap + LATE_FRAMES} < reached OR analysis_id < (SELECT max(analysis_id) FROM {rows})"""


@registry.query(with_views("frame_rel") + ", " + collapse_sql(
    "frame_rel", "analysis_id, relation_type, class_id", 48) + closed_sql("intervals", "frame_rel", "end_frame", 48, "frame"))
def stream_frames_to_intervals(v: Views):
    seen = StreamViews(v.spark, v.sf_dir).observed.select(
        "analysis_id", F.col("event_type").alias("relation_type"), F.col("user_id").alias("class_id"),
        "frame")
    return drain(v.spark, stream_intervals(
        seen, 24, ["analysis_id", "relation_type", "class_id"], started=started(), fps=FPS, lateness=LATENESS))


@registry.query(with_views("api") + ", " + coalesced_sql("api", "analysis_id, audio_class", 60) + closed_sql(
    "intervals", "api", "end_frame", 60, "sf"))
def stream_coalesce_windows(v: Views):
    rows = StreamViews(v.spark, v.sf_dir).audio.select(
        "analysis_id", "audio_class", F.col("sf").alias("start_frame"), F.col("ef").alias("end_frame"),
        "confidence")
    return drain(v.spark, stream_coalesce_audio(rows, 60, started=started(), fps=FPS, lateness=LATENESS))


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, r.arg2 AS r_arg2, r.sf AS r_sf, r.ef AS r_ef, s.arg2 AS s_arg2, s.sf AS s_sf, s.ef AS s_ef
    FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND {predicate_sql('Bef', 30, rho=1)}""")
def stream_bounded_before(v: Views):
    def side(pred: str, prefix: str) -> DataFrame:
        rows = StreamViews(v.spark, v.sf_dir).iv.where(F.col("pred") == pred)
        return rows.select("analysis_id", *[F.col(c).alias(prefix + c) for c in ("arg2", "sf", "ef")])

    return drain(v.spark, stream_before(side("A", "r_"), side("R", "s_"), 30, rho=1, left_started=started(),
                                        right_started=started(), fps=FPS, lateness=LATENESS))


@registry.query(TRACKED_SQL)
def stream_tracked_identities(v: Views):
    return drain(v.spark, stream_track(StreamViews(v.spark, v.sf_dir).objects, rate=1))


@registry.query(SIMILAR_SQL)
def stream_tracked_identities_similar(v: Views):
    """Streamed detections take their vectors from the stored table."""
    looks = v.table("embeddings").select(F.col("vec_id").cast("int").alias("ordinal"), "embedding")
    seen = StreamViews(v.spark, v.sf_dir).objects.join(looks, "ordinal", "left")
    return drain(v.spark, stream_track_similar(seen, rate=1, k=4, cap=8))
