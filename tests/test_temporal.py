from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.chain import Condition, Duration, chain, class_labels
from spanloom.operators.range_join import overlap_join
from spanloom.operators.select import any_of, pick
from spanloom.operators.sliced import before_in_tiles, sliced
from spanloom.operators.temporal import (
    OPERATORS, Temporal, before_exists, classify_pair, first_after, temporal_join,
)

INVERSE = {"Bef": "Aft", "DJ": "RDJ", "LOJ": "ROJ"}
LEFT, RIGHT = ("r_s", "r_e"), ("s_s", "s_e")
ON = [("r_k", "s_k")]


def holds(op, r, s, delta=None, epsilon=None, zeta="<=", eta="<=", rho=0):
    """The definition of each operator on two plain intervals."""
    cmp = {"<=": lambda a, b: a <= b, "<": lambda a, b: a < b,
           ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
    z, n = cmp[zeta], cmp[eta]
    if op in ("Aft", "RDJ", "ROJ"):
        forward = {v: k for k, v in INVERSE.items()}[op]
        return holds(forward, s, r, delta, epsilon, zeta, eta, rho)
    (rs, re), (ss, se) = r, s
    d = float("inf") if delta is None else delta + rho
    e = float("inf") if epsilon is None else epsilon + rho
    return {
        "Bef": lambda: z(re, ss + rho) and ss - re <= d,
        "SP": lambda: z(rs - rho, ss) and ss < re + rho and ss - rs <= d,
        "EF": lambda: rs - rho < se and n(se, re + rho) and re - se <= e,
        "DJ": lambda: (z(ss - rho, rs) and rs <= se + rho and ss - rho <= re and n(re, se + rho)
                       and rs - ss <= d and se - re <= e),
        "LOJ": lambda: (z(rs - rho, ss) and ss < re + rho and ss - rho < re and n(re, se + rho)
                        and ss - rs <= d and se - re <= e),
    }[op]()


def tables(spark, left, right):
    return (spark.createDataFrame([(i, k, s, e) for i, (k, s, e) in enumerate(left)],
                                  "r_id int, r_k int, r_s long, r_e long"),
            spark.createDataFrame([(i, k, s, e) for i, (k, s, e) in enumerate(right)],
                                  "s_id int, s_k int, s_s long, s_e long"))


def matched(left, right, spec, **options):
    rows = temporal_join(left, right, spec, on=ON, left_bounds=LEFT, right_bounds=RIGHT, **options)
    return sorted((x.r_id, x.s_id) for x in rows.select("r_id", "s_id").collect())


def expected(left, right, spec):
    p = (spec.delta, spec.epsilon, spec.zeta, spec.eta, spec.rho)
    return sorted((i, j) for i, r in enumerate(left) for j, s in enumerate(right)
                  if r[0] == s[0] and holds(spec.op, r[1:], s[1:], *p))


@pytest.fixture(scope="module")
def mixed():
    """Short, long and zero-length intervals; recording 0 holds a third of the rows."""
    rng = random.Random(7)

    def rows(n):
        out = []
        for _ in range(n):
            start = rng.randrange(-40, 400)
            length = rng.choice([0, 1, 3, 10, 40, 300])
            out.append((0 if rng.random() < 0.34 else rng.randrange(1, 5), start, start + length))
        return out + out[:3]

    return rows(90), rows(90)


GRID = [
    Temporal(op, delta, epsilon, zeta, eta, rho)
    for op in OPERATORS
    for (delta, epsilon), (zeta, eta), rho in [
        ((20, 20), ("<=", "<="), 0), ((20, None), ("<", "<"), 3), ((None, 20), ("<=", "<"), 1),
        ((None, None), ("<=", "<="), 2), ((20, 20), (">=", ">"), 1), ((0, 0), ("<=", "<="), 0),
        ((None, None), ("<", ">="), 0),
    ]
]


@pytest.mark.parametrize("op", OPERATORS)
def test_both_strategies_equal_the_definition(spark, mixed, op):
    left, right = mixed
    l, r = tables(spark, left, right)
    for spec in (s for s in GRID if s.op == op):
        want = expected(left, right, spec)
        assert matched(l, r, spec) == want, spec
        assert matched(l, r, spec, strategy="recording") == want, spec


def test_salted_open_join(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    for spec in (Temporal("Bef"), Temporal("Aft", zeta="<", rho=1), Temporal("SP", delta=5, zeta=">")):
        assert matched(l, r, spec, salt=5) == expected(left, right, spec)


def test_open_join_in_tiles(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    for spec in (Temporal("Bef"), Temporal("Bef", zeta="<", rho=3), Temporal("Aft", zeta="<", rho=1), Temporal("Aft")):
        for rows in (1, 7, 1 << 14):
            assert matched(l, r, spec, slice_rows=rows) == expected(left, right, spec), (spec, rows)
    # What cannot be sliced keeps its own way.
    for spec in (Temporal("Bef", zeta=">"), Temporal("SP", delta=5), Temporal("Bef", delta=20)):
        assert matched(l, r, spec, slice_rows=7) == expected(left, right, spec)
    nothing = tables(spark, [], [])[0]
    assert matched(nothing, r, Temporal("Bef"), slice_rows=7) == []
    with pytest.raises(ValueError):
        before_in_tiles(l, r, ON, "r_e", "s_s", 0, F.lit(True), 0)


def test_slices_of_a_hot_key_are_bounded(spark):
    """2,000 rows of one key, half of them at one place: no slice holds more than its share, and later ones lie later."""
    hot = spark.range(2_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, 500_000).otherwise(F.col("id") * 997).alias("at"), "id")
    held = sliced(hot, ["k"], "at", 90, "slice").groupBy("slice").agg(
        F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("slice").collect()
    assert [h.slice for h in held] == list(range(23)) and [h.n for h in held] == [90] * 22 + [20]
    assert all(a.high <= b.low for a, b in zip(held, held[1:]))


def test_first_after(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    rows = first_after(l, r, on=ON, left_end="r_e", right_start="s_s", payload="s_id").collect()
    assert len(rows) == len(left)
    for row in rows:
        k, _, end = left[row.r_id]
        later = sorted((s, j) for j, (sk, s, _) in enumerate(right) if sk == k and s >= end)
        assert (row.s_s, row.s_id) == (later[0] if later else (None, None))


def test_boundary_grid(spark):
    """All thirteen relative placements of two intervals, around the thresholds."""
    points = list(itertools.combinations_with_replacement(range(0, 8, 1), 2))
    left = [(1, 2, 5), (1, 3, 3)]
    right = [(1, a, b) for a, b in points]
    l, r = tables(spark, left, right)
    specs = [Temporal(op, d, d, z, z, rho) for op in OPERATORS for d in (None, 1)
             for z in ("<=", "<") for rho in (0, 1)]
    names = [f"m{i}" for i in range(len(specs))]
    args = [F.col(c) for c in (*LEFT, *RIGHT)]
    rows = l.join(r, l.r_k == r.s_k).select(
        *LEFT, *RIGHT, *[s.predicate(*args).alias(n) for n, s in zip(names, specs)]).collect()
    assert len(rows) == len(left) * len(right)
    for row in rows:
        for name, s in zip(names, specs):
            want = holds(s.op, (row.r_s, row.r_e), (row.s_s, row.s_e), s.delta, s.epsilon, s.zeta,
                         s.eta, s.rho)
            assert row[name] == want, (s, row)


@pytest.mark.parametrize("op", sorted(INVERSE))
def test_inverse_operators(spark, mixed, op):
    l, r = tables(spark, *mixed)
    forward = matched(l, r, Temporal(op, 20, 20))
    swapped = temporal_join(r, l, Temporal(INVERSE[op], 20, 20), on=[("s_k", "r_k")],
                            left_bounds=RIGHT, right_bounds=LEFT)
    assert forward == sorted((x.r_id, x.s_id) for x in swapped.collect())


@pytest.mark.parametrize("op", OPERATORS)
def test_monotone_in_every_threshold(spark, mixed, op):
    l, r = tables(spark, *mixed)
    base = set(matched(l, r, Temporal(op, 10, 10)))
    for wider in (Temporal(op, 15, 10), Temporal(op, 10, 15), Temporal(op, 10, 10, rho=2),
                  Temporal(op)):
        assert base <= set(matched(l, r, wider))


def test_semi_and_anti_keep_duplicates(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    for op in OPERATORS:
        spec = Temporal(op, 20, 20)
        hit = {i for i, _ in expected(left, right, spec)}
        for how, want in (("left_semi", hit), ("left_anti", set(range(len(left))) - hit)):
            rows = temporal_join(l, r, spec, on=ON, left_bounds=LEFT, right_bounds=RIGHT, how=how)
            assert sorted(x.r_id for x in rows.collect()) == sorted(want), (op, how)


def test_unbounded_before_exists(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    for strict, rho in ((False, 0), (True, 2)):
        spec = Temporal("Bef", zeta="<" if strict else "<=", rho=rho)
        rows = before_exists(l, r, on=ON, left_end="r_e", right_start="s_s", rho=rho, strict=strict)
        assert sorted(x.r_id for x in rows.collect()) == sorted({i for i, _ in expected(left, right, spec)})


def test_overlap_join(spark, mixed):
    left, right = mixed
    l, r = tables(spark, left, right)
    rows = overlap_join(l, r, ON, LEFT, RIGHT).collect()
    want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right)
            if a[0] == b[0] and b[1] <= a[2] and b[2] >= a[1]]
    assert sorted((x.r_id, x.s_id) for x in rows) == want


def test_seconds_domain(spark):
    left = spark.createDataFrame([(0, 1, 0.0, 1.25)], "r_id int, r_k int, r_s double, r_e double")
    right = spark.createDataFrame([(i, 1, s, s + 1) for i, s in enumerate((1.25, 3.25, 3.26, -0.5))],
                                  "s_id int, s_k int, s_s double, s_e double")
    assert matched(left, right, Temporal("Bef", delta=2)) == [(0, 0), (0, 1)]
    assert matched(left, right, Temporal("SP")) == []


def test_plan_spreads_one_recording(spark, mixed):
    """Bounded operators join on a time bucket, never by nested loops."""
    l, r = tables(spark, *mixed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for op in OPERATORS:
            spec = Temporal(op, 20, 20)
            rows = temporal_join(l, r, spec, on=ON, left_bounds=LEFT, right_bounds=RIGHT)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "__bucket" in plan
            assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_classification(spark):
    rows = spark.createDataFrame(
        [(0, 5, 5, 9), (5, 9, 0, 5), (2, 3, 0, 9), (0, 9, 2, 3), (0, 5, 3, 9), (3, 9, 0, 5)],
        "a long, b long, c long, d long")
    got = rows.select(classify_pair(*[F.col(x) for x in "abcd"]).alias("x")).select("x.*").collect()
    assert [tuple(x) for x in got] == [
        ("Bef", 0, None), ("Aft", 0, None), ("DJ", 2, 6), ("RDJ", 2, 6), ("LOJ", 3, 4), ("ROJ", 3, 4)]


def test_rejects_bad_parameters():
    for bad in (dict(op="Near"), dict(op="Bef", zeta="=="), dict(op="EF", eta="!"), dict(op="SP", rho=-1)):
        with pytest.raises(ValueError):
            Temporal(**bad)
    with pytest.raises(ValueError):
        Condition("M1.arg1", "~", "M2.arg1")
    with pytest.raises(ValueError):
        Duration("M1", "M1", ">=", float("inf"))
    with pytest.raises(ValueError):
        any_of(pick("shout"), pick("running")).source()


def test_thresholds_as_columns_bucket_too(spark, mixed):
    """A bound on the column thresholds sizes the buckets and changes no match."""
    left, right = mixed
    l, r = tables(spark, left, right)
    l = l.withColumn("d", F.when(F.col("r_id") % 4 == 0, F.lit(None)).otherwise(F.col("r_id") % 7))
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[0] == b[0]
                  and holds("Bef", a[1:], b[1:], i % 7) and i % 4)
    known = l.where("d IS NOT NULL")
    for bound in (None, 6):
        spec = Temporal("Bef", delta=F.col("d"), bucket_delta=bound)
        assert matched(known, r, spec) == want
    assert len(matched(l, r, Temporal("Bef", delta=F.col("d")))) > len(want)


def test_chain_promotes_equalities(spark):
    rows = spark.createDataFrame([(1, 7, 0, 5), (1, 7, 6, 9), (1, 8, 6, 9)],
                                 "analysis_id int, arg1 int, sf long, ef long")
    out = chain([rows, rows], [Temporal("Bef")], [Condition("M1.arg1", "=", "M2.arg1")])
    assert [(x.M1_sf, x.M2_arg1) for x in out.collect()] == [(0, 7)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = plan[plan.index("SortMergeJoin"):].split("]")[0]
    assert "M1_arg1" in keys
    with pytest.raises(ValueError):
        chain([rows, rows], [Temporal("Bef")], [Condition("M1.arg1", "=", "M9.arg1")])


def test_output_labels():
    selections = [pick("physical_altercation", arg1="person", arg2="person"),
                  pick("carrying", arg1="person", arg2="object")]
    assert class_labels(["M1.arg1", "M1.arg2", "M2.arg2", "M2.ef"], selections) == [
        "M1_person", "M1_person2", "M2_object", "M2_ef"]
