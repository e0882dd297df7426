"""Maintaining stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.islands import class_map, frames_to_intervals, participant_sets
from spanloom.operators.select import label_participants
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views
from spanloom.session import scratch_dir
from spanloom.sources import stored as changes, tables as tb

registry = Registry()


@registry.query(with_views("iv") + """
    SELECT analysis_id, pred, count(*) AS n, min(sf) AS first_sf, max(ef) AS last_ef FROM iv GROUP BY 1, 2""")
def read_intervals(v: Views):
    """A full typed read: written under the declared schema, read back, summarised."""
    path = scratch_dir(v.spark, "intervals")
    stored = v.iv.select(
        F.xxhash64("analysis_id", "pred", "arg1", "arg2", "sf").alias("relation_id"),
        F.col("analysis_id").cast("string").alias("analysis_id"), F.col("sf").alias("start_frame"),
        F.col("ef").alias("end_frame"), F.col("pred").alias("relation_type"))
    tb.write_table(stored, path, mode="overwrite", buckets=4)
    rows = tb.read_table(v.spark, path, "visual_per_interval")
    return rows.groupBy(F.col("analysis_id").cast("long").alias("analysis_id"),
                        F.col("relation_type").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.min("start_frame").alias("first_sf"),
        F.max("end_frame").alias("last_ef"))


@registry.query(with_views("iv") + "SELECT * FROM iv WHERE analysis_id IN (3, 5, 8, 13, 21)")
def scan_recordings(v: Views):
    return tb.scan(v.iv, [3, 5, 8, 13, 21])


_INTERVALS = with_views("relations") + """,
    s AS (SELECT analysis_id, frame, relation_id, relation_type, list_sort(list_distinct(list(class_id))) AS participants
      FROM relations GROUP BY 1, 2, 3, 4),
    d AS (SELECT DISTINCT analysis_id, relation_type, participants, frame FROM s),
    g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY analysis_id, relation_type, participants
        ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS f FROM d),
    n AS (SELECT *, sum(f) OVER (PARTITION BY analysis_id, relation_type, participants ORDER BY frame) AS island FROM g),
    i AS (SELECT analysis_id, relation_type, participants, min(frame) AS start_frame, max(frame) AS end_frame
      FROM n GROUP BY analysis_id, relation_type, participants, island)"""


def _intervals(v: Views):
    return frames_to_intervals(participant_sets(v.relations), 1)


@registry.query(_INTERVALS + """
    SELECT analysis_id, relation_type, start_frame, end_frame, unnest(participants) AS class_id FROM i""")
def intervals_and_children(v: Views):
    """Ids are generated, so the result is the join back over them."""
    parents, children = tb.intervals_with_participants(_intervals(v))
    return parents.join(children.drop("analysis_id"), "relation_id").drop("relation_id")


@registry.query(_INTERVALS + """
    SELECT x.analysis_id, x.relation_type, x.start_frame, x.end_frame, x.class_id, coalesce(c.class, 'unknown') AS class
    FROM (SELECT * EXCLUDE participants, unnest(participants) AS class_id FROM i) x
    LEFT JOIN (SELECT analysis_id, CAST(user_id AS INT) AS class_id, max_by(event_type, (frame, event_type)) AS class
      FROM observed GROUP BY 1, 2) c ON c.analysis_id = x.analysis_id AND c.class_id = x.class_id""")
def participant_classes(v: Views):
    classes = class_map(v.observed.select(
        "analysis_id", F.col("user_id").cast("int").alias("class_id"), "frame",
        F.col("event_type").alias("class")))
    return label_participants(_intervals(v), classes)


@registry.query("""
    SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def keep_first_on_key(v: Views):
    rows = v.table("events").select("event_id", "user_id", "event_type", "value")
    return tb.keep_first(rows, ["user_id", "event_type"], ["event_id"])


@registry.query("""
    SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(v: Views):
    rows = v.table("events").select("event_id", "user_id", "event_type", "value")
    old, new = rows.where("value < 20"), rows.where("value >= 20")
    return tb.upsert_latest(old, new, ["user_id", "event_type"], "event_id")


_DELETE = with_views("observed") + """,
    i AS (SELECT event_id AS relation_id, analysis_id, event_type AS relation_type, frame FROM observed),
    p AS (SELECT event_id AS relation_id, unnest([CAST(user_id AS INT), k + 10000]) AS class_id FROM observed)"""


def _stored(v: Views):
    parents = v.observed.select(F.col("event_id").alias("relation_id"), "analysis_id",
                                F.col("event_type").alias("relation_type"), "frame")
    children = v.relations.select("relation_id", "class_id")
    doomed = v.observed.where("analysis_id >= 7").select("analysis_id")
    return tb.delete_recordings(parents, children, doomed)


@registry.query(_DELETE + " SELECT * FROM i WHERE analysis_id < 7")
def delete_recording_intervals(v: Views):
    return _stored(v)[0]


@registry.query(_DELETE + """
    SELECT p.relation_id, p.class_id FROM p JOIN i USING (relation_id) WHERE i.analysis_id < 7""")
def delete_recording_participants(v: Views):
    return _stored(v)[1]


@registry.query("""
    SELECT CAST(doc_id AS INT) AS scene, lower(replace(trim(lang || ' X '), ' ', '_')) AS event,
      CASE WHEN toxic = 1 THEN 'scream' END AS audio FROM labels JOIN documents USING (doc_id)
    WHERE quality = 1 AND toxic = 1""")
def clean_expected_events(v: Views):
    """Rows without a scene or without audio are dropped; labels are canonical."""
    from spanloom.functions.text import canonical_class

    raw = v.table("labels").join(v.table("documents").select("doc_id", "lang"), "doc_id").select(
        F.when(F.col("quality") == 1, F.col("doc_id").cast("double")).alias("scene"),
        F.concat("lang", F.lit(" X ")).alias("event"),
        F.when(F.col("toxic") == 1, "scream").otherwise("").alias("audio"))
    return tb.clean_expected(raw, need_audio=True).withColumn("event", canonical_class(F.col("event")))


@registry.query("""
    SELECT CAST(p_size AS INT) AS scene, CASE p_size % 3 WHEN 1 THEN 'audio' ELSE 'visual' END AS modality,
      replace(lower(trim(p_name)), ' ', '_') AS class, p_partkey AS start_frame FROM part
    WHERE p_size % 5 <> 0 AND p_size % 3 = 1""")
def clean_ground_truth(v: Views):
    raw = v.table("part").select(
        F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("scene"),
        F.when(F.col("p_size") % 3 == 1, "audio").otherwise("visual").alias("modality"),
        F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("class"),
        F.col("p_partkey").alias("start_frame"))
    return tb.clean_ground_truth(raw, "audio")


@registry.query("""
    SELECT 'merged_s' || (l_partkey % 50) AS analysis_id, l_returnflag AS pred, 'a' AS run FROM lineitem
      WHERE l_linestatus = 'F'
    UNION ALL SELECT CASE WHEN l_partkey % 2 = 0 THEN 'merged_s' || (l_partkey % 50) ELSE 'plain' END,
      l_returnflag, NULL FROM lineitem WHERE l_linestatus = 'O'""")
def rekey_runs(v: Views):
    """Runs with different id patterns and columns become one corpus."""
    scene = (F.col("l_partkey") % 50).cast("string")
    rows = v.table("lineitem")
    one = rows.where("l_linestatus = 'F'").select(
        F.concat(F.lit("ab3_s"), scene, F.lit(".mp4")).alias("analysis_id"),
        F.col("l_returnflag").alias("pred"), F.lit("a").alias("run"))
    two = rows.where("l_linestatus = 'O'").select(
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("model_x_s"), scene)).otherwise("plain").alias("analysis_id"),
        F.col("l_returnflag").alias("pred"))
    return tb.rekey([one, two], "merged")


@registry.query(with_views("iv") + """
    SELECT analysis_id, CAST(to_json({'analysis_id': analysis_id, 'pred': pred, 'arg1': CASE WHEN sf % 2 = 0 THEN arg1 END,
      'sf': sf, 'ef': ef}) AS VARCHAR) AS record FROM iv""")
def json_records(v: Views):
    rows = v.iv.select("analysis_id", "pred", F.when(F.col("sf") % 2 == 0, F.col("arg1")).alias("arg1"),
                       "sf", "ef")
    return tb.json_records(rows, keep=["analysis_id"])


@registry.query(with_views("vpi", "api") + """
    SELECT relation_type AS config, 'visual' AS table_name, count(*) AS n FROM vpi GROUP BY 1
    UNION ALL SELECT audio_class, 'audio', count(*) FROM api GROUP BY 1""")
def table_row_counts(v: Views):
    return tb.row_counts({
        "visual": v.visual.withColumnRenamed("relation_type", "config"),
        "audio": v.audio.withColumnRenamed("audio_class", "config")}, ["config"])


@registry.query(with_views("iv") + """
    SELECT p_partkey AS analysis_id, p_name FROM part WHERE p_partkey NOT IN (
      SELECT analysis_id FROM iv WHERE pred = 'A' AND ef - sf >= 45)""")
def unprocessed_recordings(v: Views):
    inputs = v.table("part").select(F.col("p_partkey").alias("analysis_id"), "p_name")
    return tb.unprocessed(inputs, v.iv.where("pred = 'A' AND ef - sf >= 45"))


# -- changes in place -------------------------------------------------------------

_UPSERT = with_views("observed") + """,
    t AS (SELECT analysis_id, event_type, user_id, event_id, value FROM observed)
    SELECT * FROM t WHERE event_id % 5 > 0 OR analysis_id IN (2, 5)
    QUALIFY row_number() OVER (PARTITION BY analysis_id, event_type, user_id ORDER BY event_id DESC) = 1"""


@registry.query(_UPSERT)
def upsert_stored_buckets(v: Views):
    """A stored table takes late rows of two recordings: only their buckets are written again."""
    rows = v.observed.select("analysis_id", "event_type", "user_id", "event_id", "value")
    path, keys = scratch_dir(v.spark, "stored"), ["analysis_id", "event_type", "user_id"]
    first = rows.where("event_id % 5 > 0")
    tb.write_table(tb.upsert_latest(first.limit(0), first, keys, "event_id"), path, mode="overwrite", buckets=8)
    late = rows.where("event_id % 5 = 0 AND analysis_id IN (2, 5)")
    changes.upsert(v.spark, path, late, keys, "event_id", buckets=8)
    return changes.stored(v.spark, path).select(*keys, "event_id", "value")


@registry.query(_DELETE + """
    SELECT i.analysis_id, i.relation_id, i.frame, p.class_id FROM i JOIN p USING (relation_id) WHERE i.analysis_id NOT IN (1, 4, 7)""")
def delete_stored_recordings(v: Views):
    """Intervals and participants of three recordings leave two stored tables."""
    intervals = v.observed.select(F.col("event_id").alias("relation_id"), "analysis_id", "frame")
    participants = v.relations.select("relation_id", "analysis_id", "class_id")
    paths = [scratch_dir(v.spark, name) for name in ("intervals", "participants")]
    for rows, path in zip((intervals, participants), paths):
        tb.write_table(rows, path, mode="overwrite", buckets=8)
    changes.delete(v.spark, paths, v.observed.where("analysis_id IN (1, 4, 7)").select("analysis_id"), buckets=8)
    left = [changes.stored(v.spark, path) for path in paths]
    return left[0].join(left[1].drop("analysis_id"), "relation_id").select("analysis_id", "relation_id", "frame", "class_id")


# -- orderings -------------------------------------------------------------------

def _runs(v: Views):
    return v.table("orders").select(F.col("o_orderkey").alias("analysis_id"),
                                    F.col("o_orderdate").alias("created_at"),
                                    F.col("o_orderstatus").alias("condition"))


@registry.query("""
    SELECT o_orderkey AS analysis_id, CAST(o_orderdate AS DATE) AS created_on, o_orderstatus AS condition
    FROM orders ORDER BY o_orderdate DESC, o_orderkey""")
def runs_newest_first(v: Views):
    return tb.runs_newest_first(_runs(v)).select(
        "analysis_id", F.col("created_at").cast("date").alias("created_on"), "condition")


@registry.query("""
    SELECT o_orderkey AS analysis_id, o_orderstatus AS condition FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""")
def latest_run(v: Views):
    return tb.latest_run(_runs(v)).select("analysis_id", "condition")


@registry.query("""
    SELECT DISTINCT o_orderpriority AS id, o_orderstatus AS condition FROM orders
    ORDER BY condition, id""")
def event_catalogue(v: Views):
    specs = v.table("orders").select(F.col("o_orderpriority").alias("id"),
                                     F.col("o_orderstatus").alias("condition")).distinct()
    return tb.catalogue(specs)
