"""Chunks are placed once and scanned in small tasks."""

from __future__ import annotations

import math
import random

from spanloom.operators.islands import merge_close
from spanloom.operators.prefix import prefix_max


def test_chunks_are_placed_once(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, None]), rng.choice(["a", None]), s, s + rng.choice([0, 3]), rng.choice([None, math.nan, 0.5, 0.25]))
            for s in (rng.randrange(3000) for _ in range(500))]
    given = spark.createDataFrame(rows, "id int, kind string, sf long, ef long, confidence double").repartition(3)
    got = merge_close(given, ["id", "kind"], "sf", "ef", 2, maxima=["confidence"], cells_per_chunk=20)
    want = []
    for key in {r[:2] for r in rows}:
        for _, _, s, e, c in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            c = [] if c is None else [math.inf if math.isnan(c) else c]
            if want and want[-1][:2] == key and s <= want[-1][3] + 2:
                want[-1] = (*key, want[-1][2], max(want[-1][3], e), want[-1][4] + c)
            else:
                want.append((*key, s, e, c))
    found = [(*r[:4], None if r[4] is None else math.inf if math.isnan(r[4]) else r[4]) for r in map(tuple, got.collect())]
    assert sorted(map(str, found)) == sorted(str((*w[:4], max(w[4], default=None))) for w in want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("ReusedExchange") == 1
    # One exchange of the chunks, in all partitions, and none of the pieces by their null-safe keys.
    assert "hashpartitioning(__place#" in plan and "isnull(id" not in plan


def test_running_values_are_placed_once(spark):
    """Null keys of running values meet their chunk's summary without being placed anew."""
    rng = random.Random(5)
    rows = sorted({(rng.choice([1, None]), rng.choice(["a", None]), rng.randrange(400)) for _ in range(300)}, key=str)
    got = prefix_max(spark.createDataFrame(rows, "id int, kind string, at long"), ["id", "kind"], "at", "at", "before", size=20)
    want = [(*r, max((o[2] for o in rows if o[:2] == r[:2] and o[2] < r[2]), default=None)) for r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(__place#" in plan and "isnull(id" not in plan
