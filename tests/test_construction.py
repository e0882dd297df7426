from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import islands, prefix
from spanloom.operators.matching import class_outcomes


def merge(rows, gap):
    """Reference merge of (key, start, end, score) rows, one key at a time."""
    out = []
    for key in sorted({r[0] for r in rows}):
        cur = None
        for _, s, e, c in sorted(r for r in rows if r[0] == key):
            if cur and s <= cur[2] + gap:
                cur = (key, cur[1], max(cur[2], e), max(cur[3], c))
            else:
                if cur:
                    out.append(cur)
                cur = (key, s, e, c)
        out.append(cur)
    return out


@pytest.fixture(scope="module")
def pieces():
    """One key holds most rows, one interval reaches over many others, copies abound."""
    rng = random.Random(3)
    rows = [("hot", s, s + rng.choice([0, 2, 5, 30]), rng.random())
            for s in (rng.randrange(-500, 3000) for _ in range(260))]
    rows += [("hot", 700, 1900, 0.5)] * 20
    rows += [(k, s, s + 4, rng.random()) for k in ("a", "b") for s in rng.sample(range(900), 30)]
    return rows


@pytest.mark.parametrize("gap", [0, 1, 7, 40])
def test_merge_for_any_chunking(spark, pieces, gap):
    df = spark.createDataFrame(pieces, "k string, s long, e long, c double")
    want = merge(pieces, gap)
    for cells in (1, 3, 50, islands.CELLS_PER_CHUNK, None):
        got = islands.merge_close(df, ["k"], "s", "e", gap, ["c"], cells_per_chunk=cells)
        assert sorted(map(tuple, got.select("k", "s", "e", "c").collect())) == want, cells


def test_frames_collapse(spark):
    frames = [(1, "x", f) for f in (0, 24, 48, 97, 145, 194, 194, 1000)]
    df = spark.createDataFrame(frames, "analysis_id int, relation_type string, frame long")
    got = islands.frames_to_intervals(df, 24, ["analysis_id", "relation_type"])
    assert sorted((r.start_frame, r.end_frame) for r in got.collect()) == [
        (0, 48), (97, 145), (194, 194), (1000, 1000)]


def test_running_values_for_any_chunking(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.randrange(50)) for k in ("a", "b") for o in rng.sample(range(-200, 800), 120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for size in (1, 16, 5000):
        sums = {(r.k, r.o): r.x for r in prefix.prefix_sum(df, ["k"], "o", "v", "x", size).collect()}
        tops = {(r.k, r.o): r.x for r in prefix.prefix_max(df, ["k"], "o", "v", "x", size).collect()}
        odd = df.withColumn("w", F.when(F.col("v") % 5 == 0, F.col("v")))
        lasts = {(r.k, r.o): r.x for r in prefix.carry_last(odd, ["k"], "o", ["v"], "w", "x", size).collect()}
        for k, o, _ in rows:
            earlier = sorted((b, c) for a, b, c in rows if a == k and b < o)
            assert sums[k, o] == sum(c for _, c in earlier)
            assert tops[k, o] == max((c for _, c in earlier), default=None)
            known = [c for b, c in sorted((b, c) for a, b, c in rows if a == k and b <= o) if c % 5 == 0]
            assert lasts[k, o] == (known[-1] if known else None)


def test_windows(spark):
    recordings = spark.createDataFrame([(1, 16000 * 12), (2, 16000 * 3), (3, 4000)], "id int, n long")
    rows = islands.analysis_windows(recordings, F.col("n"), 16000, F.lit(24), 5.0, 2.5).collect()
    assert sorted((r.id, r.start_frame, r.end_frame) for r in rows) == [
        (1, 0, 120), (1, 60, 180), (1, 120, 240), (2, 0, 72)]
    capped = islands.analysis_windows(recordings, F.col("n"), 16000, F.lit(24), 5.0, 2.5, limit=1)
    assert capped.where("id = 1").count() == 1


def test_top_label_ties(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "c", 0.01)], "w int, label string, score double")
    rows = islands.top_label(df, ["w"]).collect()
    assert sorted((r.w, r.label) for r in rows) == [(1, "a"), (2, "c")]
    assert islands.top_label(df, ["w"], floor=0.05).count() == 1


def test_outcomes_against_all_pairs(spark):
    rng = random.Random(11)

    def some(n):
        return [(rng.choice([1, 1, 2]), rng.choice("xy"), s, s + rng.choice([0, 3, 60]))
                for s in (rng.randrange(400) for _ in range(n))]

    truth, preds = some(40), some(40)
    schema = "analysis_id int, class string, sf long, ef long"
    got = class_outcomes(spark.createDataFrame(truth, schema), spark.createDataFrame(preds, schema),
                         ["analysis_id"])

    def meets(a, b):
        return a[:2] == b[:2] and b[2] <= a[3] and b[3] >= a[2]

    want = [(*t[:2], "TP" if any(meets(t, p) for p in preds) else "FN") for t in truth]
    want += [(*p[:2], "FP") for p in preds if not any(meets(p, t) for t in truth)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
