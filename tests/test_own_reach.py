"""Thresholds, tolerances and strictness as columns: every row by its own parameters, spread over buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.temporal import OPERATORS, Temporal, temporal_join
from test_temporal import LEFT, ON, RIGHT, holds

DELTAS, RHOS = [None, 0, 3, 40, 900], [0, 1, 7]


def drawn(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(-50, 700)
        rows.append((i, rng.choice([1, 1, 1, 2]), start, start + rng.choice([0, 2, 15, 200]), rng.choice(DELTAS),
                     rng.choice(DELTAS), rng.choice(RHOS), rng.choice(["<=", "<", ">=", ">"]), rng.choice(["<=", "<"])))
    return rows


def frame(spark, rows, side):
    return spark.createDataFrame(rows, ", ".join(f"{side}_{c}" for c in (
        "id int", "k int", "s long", "e long", "delta int", "eps int", "rho int", "zeta string", "eta string")))


@pytest.mark.parametrize("side", ["r", "s"])
@pytest.mark.parametrize("op", OPERATORS)
def test_each_row_by_its_own_parameters(spark, op, side):
    left, right = drawn(1, 70), drawn(2, 70)
    spec = Temporal(op, **{p: F.col(f"{side}_{c}") for p, c in (
        ("delta", "delta"), ("epsilon", "eps"), ("rho", "rho"), ("zeta", "zeta"), ("eta", "eta"))})
    rows = temporal_join(frame(spark, left, "r"), frame(spark, right, "s"), spec, on=ON, left_bounds=LEFT, right_bounds=RIGHT)
    want = sorted((r[0], s[0]) for r in left for s in right if r[1] == s[1] and holds(
        op, r[2:4], s[2:4], *(lambda p: (p[4], p[5], p[7], p[8], p[6]))(r if side == "r" else s)))
    assert sorted((x.r_id, x.s_id) for x in rows.select("r_id", "s_id").collect()) == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rho", [0, 5])
def test_a_number_beside_columns(spark, rho):
    left, right = drawn(3, 60), drawn(4, 60)
    for op in ("Bef", "SP", "ROJ"):
        rows = temporal_join(frame(spark, left, "r"), frame(spark, right, "s"), Temporal(op, delta=F.col("r_delta"), rho=rho),
                             on=ON, left_bounds=LEFT, right_bounds=RIGHT)
        want = sorted((r[0], s[0]) for r in left for s in right if r[1] == s[1] and holds(op, r[2:4], s[2:4], r[4], rho=rho))
        assert sorted((x.r_id, x.s_id) for x in rows.select("r_id", "s_id").collect()) == want


def test_one_long_recording_spreads(spark):
    """Rows of one recording with short reaches fall into many join keys."""
    rows = [(i, 1, 10 * i, 10 * i + 5, 20, None, i % 3, "<=", "<=") for i in range(2000)]
    left, right = frame(spark, rows, "r"), frame(spark, rows, "s")
    spec = Temporal("Bef", delta=F.col("r_delta"), rho=F.col("r_rho"))
    joined = temporal_join(left, right, spec, on=ON, left_bounds=LEFT, right_bounds=RIGHT)
    assert joined.count() == sum(1 for i in range(2000) for j in (i + 1, i + 2) if j < 2000 and 10 * j - 10 * i - 5 <= 20 + i % 3)
    low, high = F.col("r_e") - F.col("r_rho"), F.col("r_e") + F.col("r_delta") + F.col("r_rho")
    width = F.pow(F.lit(8.0), F.ceil(F.log2(high - low + 1) / 3))
    assert left.select(F.floor(low / width)).distinct().count() > 200
