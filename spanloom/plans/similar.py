"""Similar vectors, tracking context and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import identity, similarity
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views

registry = Registry()

_PAIRS = with_views("memory") + """,
    v AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM memory),
    u AS (SELECT analysis_id, frame, class_id, class,
            list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-6)) AS e FROM v)"""


# The distance, at the precision ties are decided on.
_D = "round(greatest(1 - list_dot_product(q.e, e.e), 0), 9)"


_NEAREST = _PAIRS + f"""
    SELECT query_frame, frame, class_id, distance, place FROM (
      SELECT q.frame AS query_frame, e.frame, e.class_id, round({_D}, 6) AS distance,
        CAST(row_number() OVER (PARTITION BY q.frame ORDER BY {_D}, e.frame) AS INT) AS place
      FROM u q JOIN u e ON e.frame < q.frame) WHERE place <= 5"""


def _nearest(v: Views, tile_rows: int):
    queries = v.memory.select("analysis_id", F.col("frame").alias("query_id"), "frame", "embedding")
    rows = similarity.nearest_earlier(queries, v.memory, 5, tile_rows)
    return rows.select("query_frame", "frame", "class_id", F.round("distance", 6).alias("distance"),
                       "place")


@registry.query(_NEAREST)
def nearest_earlier_vectors(v: Views):
    return _nearest(v, similarity.TILE_ROWS)


@registry.query(_NEAREST)
def nearest_earlier_many_tiles(v: Views):
    """Tiles of 64 rows: pivots, first tiles and bounds all take part."""
    return _nearest(v, 64)


_SIMILAR = _PAIRS + f""",
    near AS (SELECT q.frame + o.ahead AS target, e.frame, e.class_id, {_D} AS d,
        row_number() OVER (PARTITION BY q.frame + o.ahead, q.frame
          ORDER BY {_D}, e.frame) AS rn
      FROM u q JOIN (SELECT unnest([1, 2, 3]) AS ahead) o ON true JOIN u e ON e.frame < q.frame + o.ahead
      WHERE q.frame + o.ahead IN (SELECT frame FROM memory)),
    best AS (SELECT target, class_id, min(d) AS d, min_by(frame, (d, frame)) AS origin FROM near WHERE rn <= 5
      GROUP BY target, class_id),
    alike AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY d, class_id) AS INT) AS place FROM best),
    recent AS (SELECT m.frame + o.ahead AS target, m.class_id, min(m.frame) AS origin FROM memory m
      JOIN (SELECT unnest([1, 2, 3]) AS ahead) o ON true
      WHERE m.frame + o.ahead IN (SELECT frame FROM memory) GROUP BY 1, 2)"""


@registry.query(_SIMILAR + """
    SELECT target AS frame, class_id, origin, round(d, 6) AS distance, place FROM alike WHERE place <= 5""")
def similar_earlier_objects(v: Views):
    rows = similarity.similar_objects(v.memory, v.memory, 1, 3, 5)
    return rows.select("frame", "class_id", "origin", F.round("distance", 6).alias("distance"), "place")


@registry.query(_SIMILAR + " SELECT target AS frame, class_id, origin FROM recent")
def recent_objects(v: Views):
    rows = similarity.recent_objects(v.memory.select("analysis_id", "frame", "class_id"), v.memory, 1, 3)
    return rows.select("frame", "class_id", "origin")


@registry.query(_SIMILAR + """,
    ctx AS (SELECT target, class_id, origin, 0 AS source, CAST(origin AS DOUBLE) AS rk FROM recent
      UNION ALL SELECT target, class_id, origin, 1, d FROM alike s WHERE place <= 5 AND NOT EXISTS (
        SELECT 1 FROM recent r WHERE r.target = s.target AND r.class_id = s.class_id))
    SELECT * FROM (SELECT target AS frame, class_id, origin, source, CAST(row_number() OVER (
      PARTITION BY target ORDER BY source, rk, class_id) AS INT) AS place FROM ctx) WHERE place <= 6""")
def tracking_context(v: Views):
    recent = similarity.recent_objects(v.memory.select("analysis_id", "frame", "class_id"), v.memory, 1, 3)
    similar = similarity.similar_objects(v.memory, v.memory, 1, 3, 5)
    rows = similarity.tracking_context(recent, similar, cap=6)
    return rows.select("frame", "class_id", "origin", "source", "place")


@registry.query(with_views("memory") + """,
    c AS (SELECT class, count(*) AS n FROM memory GROUP BY 1)
    SELECT count(*) AS total, min(frame) AS frame_min, max(frame) AS frame_max,
      (SELECT string_agg(class || '=' || n, ',' ORDER BY class) FROM c) AS per_class FROM memory""")
def memory_statistics(v: Views):
    rows = similarity.memory_stats(v.memory)
    pairs = F.transform(F.array_sort(F.map_entries("per_class")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("total", "frame_min", "frame_max", F.array_join(pairs, ",").alias("per_class"))


@registry.query(with_views("memory") + """
    SELECT frame, class_id, class, count(*) OVER () AS total FROM memory
    WHERE class = 'person' AND frame BETWEEN 10 AND 400 ORDER BY frame LIMIT 50 OFFSET 20""")
def list_memory_page(v: Views):
    rows = similarity.list_entries(v.memory.drop("embedding"), "person", 10, 400, limit=50, offset=20)
    return rows.select("frame", "class_id", "class", "total")


# -- identities -----------------------------------------------------------------

@registry.query(with_views("objects") + """
    SELECT analysis_id, frame, ordinal, row_number() OVER (PARTITION BY analysis_id ORDER BY frame, ordinal)
      AS class_id FROM objects""")
def untracked_ids(v: Views):
    rows = identity.number_untracked(v.objects.select("analysis_id", "frame", "ordinal"))
    return rows.select("analysis_id", "frame", "ordinal", "class_id")


_ENTRY = "STRUCT(frame BIGINT, ordinal INT, id INT, class VARCHAR, block INT)"


def identity_sql(context: str, views: str = "", n: int = 3) -> str:
    """The rules for one object after another, all recordings in step.

    The state of a recording is its counter, the objects of the last frames (``hist``), what
    of the frame's context is still free, the numbers given in the frame, and the ids so far.
    ``context`` gives the free objects of a new frame from ``was`` (state and object).
    """
    return f"""WITH RECURSIVE {with_views("objects", "memory").removeprefix("WITH ")}{views},
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY frame, ordinal) AS i FROM objects),
    s AS (
      SELECT DISTINCT analysis_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS INT) AS ordinal,
        CAST(NULL AS INT) AS class_id, false AS fresh, 1 AS next_id, 0 AS largest, CAST([] AS {_ENTRY}[]) AS hist,
        CAST([] AS {_ENTRY}[]) AS free, CAST([] AS VARCHAR[]) AS taken, CAST([] AS {_ENTRY}[]) AS ids FROM o
      UNION ALL
      SELECT analysis_id, i, frame, ordinal, class_id, fresh, CASE WHEN fresh THEN next_id + 1 ELSE next_id END,
        greatest(largest, coalesce(class_id, 0)),
        CASE WHEN class_id IS NULL THEN hist
          WHEN len(list_filter(hist, lambda x: x.frame = now.frame AND x.id = class_id)) > 0 THEN list_transform(hist,
            lambda x: CASE WHEN x.frame = now.frame AND x.id = class_id THEN entry ELSE x END)
          ELSE list_append(hist, entry) END,
        list_filter(free, lambda x: x.id IS DISTINCT FROM class_id),
        CASE WHEN raw_id = 'new' THEN taken ELSE list_append(taken, raw_id) END,
        CASE WHEN class_id IS NULL THEN ids ELSE list_append(ids, entry) END
      FROM (SELECT *, CAST({{'frame': frame, 'ordinal': ordinal, 'id': class_id, 'class': class, 'block': block}} AS {_ENTRY}) AS entry
        FROM (SELECT *, raw_id = 'new' AND hit IS NULL AS fresh, CASE WHEN raw_id = 'new' THEN coalesce(hit, next_id)
              WHEN NOT list_contains(taken, raw_id) THEN CAST(raw_id AS INT) END AS class_id
          FROM (SELECT *, coalesce(list_filter(free, lambda x: x.class = step.class AND x.block = step.block)[1].id,
                list_filter(free, lambda x: x.class = step.class)[1].id) AS hit
            FROM (SELECT analysis_id, i, frame, ordinal, class, block, raw_id, largest, ids,
                CASE WHEN turn THEN greatest(next_id, largest + 1) ELSE next_id END AS next_id,
                CASE WHEN turn THEN recent ELSE hist END AS hist,
                CASE WHEN turn THEN {context} ELSE free END AS free,
                CASE WHEN turn THEN [] ELSE taken END AS taken
              FROM (SELECT o.*, s.frame IS DISTINCT FROM o.frame AS turn, s.next_id, s.largest, s.hist, s.free, s.taken, s.ids,
                  list_filter(s.hist, lambda x: x.frame >= o.frame - {n}) AS recent
                FROM s JOIN o ON o.analysis_id = s.analysis_id AND o.i = s.i + 1) was) step))) now
    )
    SELECT analysis_id, frame, ordinal, class_id, fresh FROM s WHERE class_id IS NOT NULL"""


# What the last frames showed, each object once, as first seen there.
_RECENT = "list_filter(recent, lambda x, k: list_position(list_transform(recent, lambda y: y.id), x.id) = k)"

_GIVEN = f""",
    known AS (SELECT k.analysis_id, k.frame, k.class, k.block, CAST(e.user_id AS INT) AS class_id FROM objects k
      JOIN observed e ON CAST(e.event_id AS INT) = k.ordinal),
    near AS (SELECT analysis_id, frame + ahead AS target, class_id, min({{'origin': frame, 'class': class, 'block': block}}) AS o
      FROM known, (SELECT unnest([1, 2, 3]) AS ahead) GROUP BY 1, 2, 3),
    ctx AS MATERIALIZED (SELECT analysis_id, target, list(CAST({{'frame': 0, 'ordinal': 0, 'id': class_id, 'class': o.class,
      'block': o.block}} AS {_ENTRY}) ORDER BY class_id) AS c FROM near GROUP BY 1, 2)"""


def _known(v: Views):
    """Objects already identified, by user: the context of later frames."""
    known = v.objects.join(v.observed.select(F.col("event_id").cast("int").alias("ordinal"),
                                             F.col("user_id").cast("int").alias("class_id")), "ordinal")
    recent = similarity.recent_objects(known.select("analysis_id", "frame", "class_id", "class", "blocks"),
                                       v.objects, 1, 3)
    return recent.withColumn("place", F.col("class_id"))


@registry.query(identity_sql("coalesce((SELECT c FROM ctx WHERE ctx.analysis_id = was.analysis_id AND ctx.target = was.frame), [])",
                             _GIVEN))
def identities_from_context(v: Views):
    return identity.assign_with_context(v.objects, _known(v))


TRACKED_SQL = identity_sql(f"{_RECENT}[1:30]")


@registry.query(TRACKED_SQL)
def tracked_identities(v: Views):
    return identity.track(v.objects, rate=1)


# The nearest entries of each remembered detection, for each of the frames it is recent in.
_MEMORY = f""",
    looks AS (SELECT frame AS ordinal, list_transform(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x / greatest(sqrt(
      list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-6)) AS e FROM memory),
    entries AS MATERIALIZED (SELECT analysis_id, frame, ordinal, class, block, e FROM objects JOIN looks USING (ordinal)
      QUALIFY raw_id = 'new' OR row_number() OVER (PARTITION BY analysis_id, frame, raw_id ORDER BY ordinal) = 1),
    near AS MATERIALIZED (SELECT q.analysis_id, q.frame, q.ordinal, ahead, m.frame AS m_frame, m.ordinal AS m_ordinal,
        m.class, m.block, {_D.replace('e.e', 'm.e')} AS d
      FROM entries q JOIN (SELECT unnest([1, 2, 3]) AS ahead) a ON true JOIN entries m ON m.analysis_id = q.analysis_id
        AND m.frame < q.frame + ahead
      QUALIFY row_number() OVER (PARTITION BY q.analysis_id, q.ordinal, ahead ORDER BY d, m.frame, m.ordinal) <= 4)"""
_ALIKE = f"""coalesce((SELECT list(CAST({{'frame': 0, 'ordinal': 0, 'id': id, 'class': b.class, 'block': b.block}} AS {_ENTRY})
      ORDER BY b.d, id) FROM (SELECT g.id, min({{'d': p.d, 'f': p.m_frame, 'o': p.m_ordinal, 'class': p.class, 'block': p.block}}) AS b
        FROM (SELECT unnest(recent) AS r) w JOIN near p ON p.analysis_id = was.analysis_id AND p.frame = w.r.frame
          AND p.ordinal = w.r.ordinal AND p.ahead = was.frame - w.r.frame
        JOIN (SELECT unnest(ids) AS g) t ON t.g.frame = p.m_frame AND t.g.ordinal = p.m_ordinal
        GROUP BY g.id ORDER BY min(p.d), g.id LIMIT 4)), [])"""
_BOTH = f"list_concat({_RECENT}, list_filter({_ALIKE}, lambda x: NOT list_contains(list_transform(recent, lambda y: y.id), x.id)))[1:8]"


SIMILAR_SQL = identity_sql(_BOTH, _MEMORY)


@registry.query(SIMILAR_SQL)
def tracked_identities_similar(v: Views):
    return identity.track_similar(v.seen, rate=1, k=4, cap=8)
