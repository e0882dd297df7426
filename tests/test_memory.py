"""Exact search over many tiles, and tracking with a recording's memory, against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import identity, nearest
from spanloom.streaming.identity import stream_track_similar
from spanloom.streaming.run import drain
from test_identity import resolve

ENTRIES = "analysis_id int, frame long, class_id int, embedding array<float>"


def unit(v):
    v = np.array(v, np.float32).astype(float)
    return v / max(np.linalg.norm(v), 1e-6)


def clustered(seed, n, recordings=2, clusters=12, spread=0.05, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    rows = [(i % recordings, i // 3, i, (centres[rng.integers(clusters)] + spread * rng.standard_normal(dim)).tolist())
            for i in range(n)]
    return rows + [(0, n, 1, [0.0] * dim), (0, n + 1, 2, rows[4][3]), (0, n + 2, 3, rows[4][3]), (None, 1, 4, rows[5][3]),
                   (0, None, 5, rows[5][3]), (1, 7, 6, None)]


def brute(rows, k):
    held = [(a, f, c, unit(v)) for a, f, c, v in rows if a is not None and f is not None and v is not None]
    out = {}
    for a, f, c, v in held:
        near = sorted((round(max(1 - float(v @ w), 0), 9), g, d) for b, g, d, w in held if b == a and g < f)
        out[a, f, c] = [(g, d) for _, g, d in near[:k]]
    return out


@pytest.mark.parametrize("tile_rows, asked", [(20, 8192), (50, 7)])
def test_many_tiles_give_the_same_neighbours(spark, monkeypatch, tile_rows, asked):
    monkeypatch.setattr(nearest, "ASKED", asked)
    monkeypatch.setattr(nearest, "ROUTED", 64)
    rows = clustered(3, 500)
    df = spark.createDataFrame(rows, ENTRIES).repartition(3)
    queries = df.select("analysis_id", F.struct("frame", "class_id").alias("query_id"), "frame", "embedding")
    found, asks, sent = nearest.steps(queries, df, 4, tile_rows)
    got = {}
    for r in nearest._least(found, 4).join(asks.select("q", "analysis_id", "query_id"), "q").orderBy("place").collect():
        got.setdefault((r.analysis_id, r.query_id.frame, r.query_id.class_id), []).append((r.frame, r.class_id))
    want = brute(rows, 4)
    assert {q: got.get(q, []) for q in want} == want
    # Clusters rule out most tiles: of the earlier ones (half of all, about), far fewer are met.
    tiles = 500 / 2 / tile_rows
    assert sum(s.count() for s in sent) / asks.count() < 0.75 * tiles


def test_tiles_are_bounded(spark):
    """One object that fills a recording: its cell is cut along the frames."""
    rows = [(1, f, o, [1.0, 0.001 * o]) for f in range(200) for o in range(2)]
    df = spark.createDataFrame(rows, ENTRIES)
    sizes = df.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("size"))
    named = df.select("analysis_id", "frame", "class_id", F.col("embedding").alias("v"))
    tiled = nearest._tiled(named, sizes, nearest._pivots(named, sizes, 30), 30)
    counts = [r["count"] for r in tiled.groupBy("tile").count().collect()]
    assert sum(counts) == 400 and max(counts) <= 31


def test_no_entries_and_no_queries(spark):
    some = spark.createDataFrame([(1, 5, 1, [1.0, 0.0])], ENTRIES)
    queries = some.select("analysis_id", F.col("frame").alias("query_id"), "frame", "embedding")
    assert nearest.nearest_earlier(queries, some.limit(0), 3).collect() == []
    assert nearest.nearest_earlier(queries.limit(0), some, 3, 1).collect() == []
    assert nearest.nearest_earlier(queries, some, 3).collect() == []


# -- tracking ----------------------------------------------------------------------

OBJECTS = "analysis_id int, frame long, ordinal int, raw_id string, class string, blocks array<int>, embedding array<float>"


def detections(seed, frames=60):
    """Objects that come and go, some for longer than the recent frames last."""
    rng, noise = random.Random(seed), np.random.default_rng(seed)
    looks = noise.standard_normal((9, 12))
    rows = []
    for rec in (1, 2):
        for f in range(0, 2 * frames, 2):
            there = rng.sample(range(9), rng.choice([0, 0, 1, 2, 3]))
            for o in there:
                raw = rng.choice(["new"] * 8 + [str(20 + o), str(20 + o), "oops"])
                vector = None if rng.random() < 0.1 else (looks[o] + 0.05 * noise.standard_normal(12)).tolist()
                rows.append((rec, f, len(rows), raw, ["person", "vehicle"][o % 2], [1 + o % 4] if rng.random() < 0.9 else [], vector))
    return rows


def replay(rows, rate, n, k, cap):
    """The rules one after another, with the whole memory at hand."""
    out = {}
    for rec in {r[0] for r in rows}:
        next_id, frames, memory = 1, {}, []
        for f in sorted({r[1] for r in rows if r[0] == rec}):
            objs = sorted(r[2:] for r in rows if r[:2] == (rec, f))
            recent = {}
            for g in sorted(frames):
                if f - n * rate <= g < f:
                    for i, (o, c, b, v) in frames[g].items():
                        recent.setdefault(i, (c, b))
            best = {}
            for g in sorted(frames):
                if f - n * rate <= g < f:
                    for i, (o, c, b, v) in frames[g].items():
                        if v is None or not b:
                            continue
                        near = sorted(((round(max(1 - float(unit(v) @ unit(w)), 0), 9), h, p), j, cc, bb)
                                      for h, p, j, cc, bb, w in memory if h < f)[:k]
                        for d, j, cc, bb in near:
                            if j not in best or d < best[j][0]:
                                best[j] = (d, cc, bb)
            ctx = dict(recent)
            for j in sorted(best, key=lambda j: (best[j][0][0], j))[:k]:
                ctx.setdefault(j, best[j][1:])
            ctx = dict(list(ctx.items())[:cap])
            shapes, largest, seen = {o[0]: o for o in objs}, next_id - 1, {}
            for o, i in resolve([x[:4] for x in objs], ctx):
                fresh = i is None
                if fresh:
                    i, next_id = next_id, next_id + 1
                largest = max(largest, i)
                _, _, c, b, v = shapes[o]
                seen[i] = (o, c, b, v)
                out[rec, f, o] = (i, fresh)
                if v is not None and b:
                    memory.append((f, o, i, c, b, v))
            next_id = max(next_id, largest + 1)
            frames[f] = seen
    return out


@pytest.mark.parametrize("seed, cap, tile_rows", [(1, 30, 4096), (2, 30, 20), (3, 3, 20)])
def test_tracking_with_memory_equals_a_replay(spark, seed, cap, tile_rows):
    rows = detections(seed)
    df = spark.createDataFrame(rows, OBJECTS).repartition(3)
    got = {(r.analysis_id, r.frame, r.ordinal): (r.class_id, r.fresh)
           for r in identity.track_similar(df, 2, 3, 4, cap, tile_rows).collect()}
    assert got == replay(rows, 2, 3, 4, cap)
    if cap > 10:
        plain = {(r.analysis_id, r.frame, r.ordinal): (r.class_id, r.fresh) for r in identity.track(df, 2).collect()}
        assert sum(f for _, f in got.values()) < sum(f for _, f in plain.values())  # the memory finds some again


def test_what_is_remembered(spark):
    v = [1.0, 2.0]
    rows = [(1, 0, 0, "new", "a", [1], v), (1, 0, 1, "7", "a", [1], v), (1, 0, 2, "7", "a", [1], v), (1, 0, 3, "x", "a", [1], v),
            (1, 0, 4, " +8 ", "a", [1], v), (1, 0, 5, "99999999999", "a", [1], v), (1, 0, 6, "new", "a", [], v),
            (1, 0, 7, "new", "a", [1], None), (1, 0, 8, "new", "a", [1], v)]
    got = identity.remembered(spark.createDataFrame(rows, OBJECTS)).collect()
    assert sorted(r.ordinal for r in got) == [0, 1, 4, 8]
    kept = [o for o, _ in identity.resolve_frame([r[2:6] for r in rows], [])]
    assert set(kept) == {0, 1, 4, 6, 7, 8}


def test_streamed_memory_equals_a_replay(spark, tmp_path):
    """Batch borders fall between frames; the memory outlives them."""
    rows = detections(5, 40)
    for lo, hi in ((0, 20), (20, 22), (22, 60), (60, 100)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], OBJECTS).coalesce(1).write.parquet(str(tmp_path / f"in/d={lo:03d}"))
    schema = spark.createDataFrame([], OBJECTS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/d=*"))
    got = {(r.analysis_id, r.frame, r.ordinal): (r.class_id, r.fresh)
           for r in drain(spark, stream_track_similar(stream, 2, 3, 4)).collect()}
    assert got == replay(rows, 2, 3, 4, 30)
