from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import identity, similarity
from spanloom.streaming.identity import stream_track
from spanloom.streaming.run import drain

SCHEMA = "analysis_id int, frame long, ordinal int, raw_id string, class string, blocks array<int>"


def sample(n_frames=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for rec in (1, 1, 2):
        for f in range(n_frames):
            for o in range(rng.choice([0, 0, 1, 2, 4])):
                raw = rng.choice(["new", "new", "new", str(rng.randrange(1, 9)), "oops"])
                rows.append((rec, f, len(rows), raw, rng.choice(["person", "vehicle"]),
                             rng.sample(range(1, 5), rng.choice([0, 1, 2]))))
    return rows


def resolve(objects, context):
    """One frame by the rules, written plainly."""
    free, taken, out = dict(context), set(), []
    for o, raw, cls, blocks in objects:
        if raw != "new":
            if raw in taken:
                continue
            taken.add(raw)
            if not raw.isdigit():
                continue
            free.pop(int(raw), None)
            out.append((o, int(raw)))
            continue
        same = [i for i, (c, _) in free.items() if c == cls]
        near = [i for i in same if not blocks or not free[i][1] or set(blocks) & set(free[i][1])]
        hit = (near or same or [None])[0]
        free.pop(hit, None)
        out.append((o, hit))
    return out


def replay(rows, context_of):
    out = {}
    for rec in {r[0] for r in rows}:
        next_id, history = 1, {}
        for f in sorted({r[1] for r in rows if r[0] == rec}):
            objs = sorted((r[2:] for r in rows if r[:2] == (rec, f)))
            shape = {o[0]: (o[2], o[3]) for o in objs}
            largest, seen = next_id - 1, {}
            for o, i in resolve(objs, context_of(rec, f, history)):
                fresh = i is None
                if fresh:
                    i, next_id = next_id, next_id + 1
                largest = max(largest, i)
                seen[i] = shape[o]
                out[rec, f, o] = (i, fresh)
            next_id = max(next_id, largest + 1)
            history[f] = seen
    return out


def as_map(df):
    return {(r.analysis_id, r.frame, r.ordinal): (r.class_id, r.fresh) for r in df.collect()}


def recent_of(rec, f, history):
    ctx = {}
    for g in sorted(history):
        if f - 3 <= g < f:
            for i, shape in history[g].items():
                ctx.setdefault(i, shape)
    return ctx


def test_tracking_equals_a_replay(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_map(identity.track(df, rate=1)) == replay(rows, recent_of)


def test_tracking_does_not_depend_on_batches(spark):
    rows = sample(60, seed=4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert as_map(identity.track(df, rate=1)) == replay(rows, recent_of)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_given_context_in_parallel(spark, chunk):
    rows = sample(seed=9)
    rng = random.Random(2)
    context = [(rec, f, p, 20 + rng.randrange(6) * 2 + p % 2, rng.choice(["person", "vehicle"]), [1 + p])
               for rec in (1, 2) for f in range(40) for p in range(rng.choice([0, 2, 3]))]
    context = list({(c[0], c[1], c[3]): c for c in context}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    ctx = spark.createDataFrame(context, "analysis_id int, frame long, place int, class_id int, class string, blocks array<int>")

    def given(rec, f, _):
        return {c[3]: (c[4], c[5]) for c in sorted(context) if c[:2] == (rec, f)}

    assert as_map(identity.assign_with_context(df, ctx, chunk)) == replay(rows, given)


def test_untracked_numbers(spark):
    rows = sample(seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1, 9, 1 << 16):
        got = identity.number_untracked(df, chunk).collect()
        for rec in (1, 2):
            ordered = sorted((r.frame, r.ordinal, r.class_id) for r in got if r.analysis_id == rec)
            assert [c for _, _, c in ordered] == list(range(1, len(ordered) + 1))


def test_stream_continues_over_batches(spark, tmp_path):
    """Ids survive batch borders and frames without objects."""
    rows = sample(seed=8)
    source = tmp_path / "in"
    for i, (lo, hi) in enumerate(((0, 13), (13, 14), (14, 40))):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"d={i}"))
        if i == 0:
            first = part
    schema = spark.createDataFrame(first, SCHEMA).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "d=*"))
    got = as_map(drain(spark, stream_track(stream, rate=1)))
    assert got == replay(rows, recent_of)


@pytest.mark.parametrize("tile", [3, 16, 4096])
def test_nearest_for_any_tiling(spark, tile):
    rng = np.random.default_rng(0)
    rows = [(rec, f, int(rng.integers(5)), rng.normal(size=6).tolist()) for rec in (1, 2) for f in range(30)
            for _ in range(int(rng.integers(0, 3)))]
    df = spark.createDataFrame(rows, "analysis_id int, frame long, class_id int, embedding array<float>")
    df = df.dropDuplicates(["analysis_id", "frame", "class_id"]).cache()
    held = [(r.analysis_id, r.frame, r.class_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    queries = df.select("analysis_id", F.struct("frame", "class_id").alias("query_id"), "frame", "embedding")
    got = {}
    for r in similarity.nearest_earlier(queries, df, 4, tile).collect():
        got.setdefault((r.analysis_id, r.query_id.frame, r.query_id.class_id), []).append(
            (r.place, round(r.distance, 6), r.frame, r.class_id))
    unit = lambda v: v / max(np.linalg.norm(v), 1e-6)
    for a, f, c, v in held:
        near = sorted((round(max(1 - float(unit(v) @ unit(w)), 0), 9), g, d) for b, g, d, w in held if b == a and g < f)
        want = [(i, round(x, 6), g, d) for i, (x, g, d) in enumerate(near[:4], 1)]
        assert sorted(got.get((a, f, c), [])) == want


def test_copies_fill_only_k_places(spark):
    """Two thirds of the vectors are copies; each query still returns k, the earliest first."""
    rows = [(1, f, 0, [1.0, 0.0] if f % 3 else [0.0, 1.0]) for f in range(60)]
    df = spark.createDataFrame(rows, "analysis_id int, frame long, class_id int, embedding array<float>")
    queries = df.select("analysis_id", F.col("frame").alias("query_id"), "frame", "embedding")
    got = similarity.nearest_earlier(queries, df, 3, 1000).where("query_id = 59").orderBy("place").collect()
    assert [(r.frame, r.distance) for r in got] == [(1, 0.0), (2, 0.0), (4, 0.0)]


def test_context_prefers_recent_and_caps(spark):
    recent = spark.createDataFrame([(1, 9, 5, 8), (1, 9, 6, 7)], "analysis_id int, frame long, class_id int, origin long")
    similar = spark.createDataFrame([(1, 9, 5, 2, 0.1), (1, 9, 7, 3, 0.3), (1, 9, 8, 1, 0.2)],
                                    "analysis_id int, frame long, class_id int, origin long, distance double")
    rows = similarity.tracking_context(recent, similar, cap=3).orderBy("place").collect()
    assert [(r.class_id, r.origin, r.source) for r in rows] == [(6, 7, 0), (5, 8, 0), (8, 1, 1)]
