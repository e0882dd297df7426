"""Temporal joins over the interval view."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.chain import (
    Condition, Duration, as_interval, chain, class_labels, default_projection, project,
)
from spanloom.operators.select import pick, select_intervals
from spanloom.operators.temporal import (
    OPERATORS, Temporal, before_exists, classify_pair, end_offset, first_after, start_offset,
    temporal_join,
)
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views

registry = Registry()

ON = [("r_analysis_id", "s_analysis_id")]
R, S = ("r_sf", "r_ef"), ("s_sf", "s_ef")
PAIR = ["r_analysis_id", "r_arg1", "r_arg2", "r_sf", "r_ef", "s_arg1", "s_arg2", "s_sf", "s_ef"]


def predicate_sql(op: str, delta=None, epsilon=None, zeta="<=", eta="<=", rho=0,
                  r="r", s="s") -> str:
    """The match condition of an operator, written from its definition."""
    if op in ("Aft", "RDJ", "ROJ"):
        partner = {"Aft": "Bef", "RDJ": "DJ", "ROJ": "LOJ"}[op]
        return predicate_sql(partner, delta, epsilon, zeta, eta, rho, s, r)
    terms = {
        "Bef": [f"{r}.ef {zeta} {s}.sf + {rho}"],
        "SP": [f"{r}.sf - {rho} {zeta} {s}.sf", f"{s}.sf < {r}.ef + {rho}"],
        "EF": [f"{r}.sf - {rho} < {s}.ef", f"{s}.ef {eta} {r}.ef + {rho}"],
        "DJ": [f"{s}.sf - {rho} {zeta} {r}.sf", f"{r}.sf <= {s}.ef + {rho}",
               f"{s}.sf - {rho} <= {r}.ef", f"{r}.ef {eta} {s}.ef + {rho}"],
        "LOJ": [f"{r}.sf - {rho} {zeta} {s}.sf", f"{s}.sf < {r}.ef + {rho}",
                f"{s}.sf - {rho} < {r}.ef", f"{r}.ef {eta} {s}.ef + {rho}"],
    }[op]
    near = {"Bef": f"{s}.sf - {r}.ef", "SP": f"{s}.sf - {r}.sf", "DJ": f"{r}.sf - {s}.sf",
            "LOJ": f"{s}.sf - {r}.sf"}.get(op)
    far = {"EF": f"{r}.ef - {s}.ef", "DJ": f"{s}.ef - {r}.ef", "LOJ": f"{s}.ef - {r}.ef"}.get(op)
    if near and delta is not None:
        terms.append(f"{near} <= {delta} + {rho}")
    if far and epsilon is not None:
        terms.append(f"{far} <= {epsilon} + {rho}")
    return " AND ".join(terms)


def _pairs_sql(condition: str, extra: str = "") -> str:
    return with_views("iv") + f"""
        SELECT r.analysis_id AS r_analysis_id, r.arg1 AS r_arg1, r.arg2 AS r_arg2, r.sf AS r_sf,
               r.ef AS r_ef, s.arg1 AS s_arg1, s.arg2 AS s_arg2, s.sf AS s_sf, s.ef AS s_ef{extra}
        FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id
        WHERE r.pred = 'A' AND s.pred = 'R' AND {condition}"""


def _pairs(v: Views, spec: Temporal, **options):
    return temporal_join(v.side("A", "r_"), v.side("R", "s_"), spec, on=ON, left_bounds=R,
                         right_bounds=S, **options)


for _op in OPERATORS:
    _bounds = {"delta": None if _op == "EF" else 30,
               "epsilon": None if _op in ("Bef", "Aft", "SP") else 30}
    registry.add(f"{_op.lower()}_bounded",
                 lambda v, s=Temporal(_op, **_bounds): _pairs(v, s).select(*PAIR),
                 _pairs_sql(predicate_sql(_op, **_bounds)))
    _loose = {**_bounds, "zeta": "<", "eta": "<", "rho": 2}
    registry.add(f"{_op.lower()}_strict_tolerant",
                 lambda v, s=Temporal(_op, **_loose): _pairs(v, s).select(*PAIR),
                 _pairs_sql(predicate_sql(_op, **_loose)))
    if _op not in ("Bef", "Aft"):
        registry.add(f"{_op.lower()}_unbounded",
                     lambda v, s=Temporal(_op): _pairs(v, s).select(*PAIR),
                     _pairs_sql(predicate_sql(_op)))


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, count(*) AS n_pairs FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND {predicate_sql('Bef', 30)} GROUP BY r.analysis_id""")
def bef_pairs_per_recording(v: Views):
    pairs = _pairs(v, Temporal("Bef", delta=30))
    return pairs.groupBy(F.col("r_analysis_id").alias("analysis_id")).agg(
        F.count(F.lit(1)).alias("n_pairs"))


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, r.arg2, r.sf, r.ef FROM iv r WHERE r.pred = 'A' AND EXISTS (
      SELECT 1 FROM iv s WHERE s.pred = 'R' AND s.analysis_id = r.analysis_id
      AND {predicate_sql('Bef', 30)})""")
def bef_bounded_exists(v: Views):
    rows = _pairs(v, Temporal("Bef", delta=30), how="left_semi")
    return rows.select(F.col("r_analysis_id").alias("analysis_id"), F.col("r_arg2").alias("arg2"),
                       F.col("r_sf").alias("sf"), F.col("r_ef").alias("ef"))


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, r.arg2, r.sf, r.ef FROM iv r WHERE r.pred = 'A' AND NOT EXISTS (
      SELECT 1 FROM iv s WHERE s.pred = 'R' AND s.analysis_id = r.analysis_id
      AND {predicate_sql('LOJ', 30, 30)})""")
def loj_bounded_absent(v: Views):
    rows = _pairs(v, Temporal("LOJ", delta=30, epsilon=30), how="left_anti")
    return rows.select(F.col("r_analysis_id").alias("analysis_id"), F.col("r_arg2").alias("arg2"),
                       F.col("r_sf").alias("sf"), F.col("r_ef").alias("ef"))


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, r.arg2, r.sf, r.ef FROM iv r WHERE r.pred = 'A' AND EXISTS (
      SELECT 1 FROM iv s WHERE s.pred = 'R' AND s.analysis_id = r.analysis_id
      AND {predicate_sql('Bef')})""")
def bef_unbounded_exists(v: Views):
    rows = before_exists(v.side("A", "r_"), v.side("R", "s_"), on=ON, left_end="r_ef",
                         right_start="s_sf")
    return rows.select(F.col("r_analysis_id").alias("analysis_id"), F.col("r_arg2").alias("arg2"),
                       F.col("r_sf").alias("sf"), F.col("r_ef").alias("ef"))


@registry.query(with_views("iv") + """,
    nxt AS (SELECT r.analysis_id, r.arg2, r.arg1, r.sf, r.ef, s.sf AS s_sf,
              row_number() OVER (PARTITION BY r.n ORDER BY s.sf, s.arg2) AS rn, s.arg2 AS s_arg2
            FROM (SELECT *, row_number() OVER () AS n FROM iv WHERE pred = 'A') r
            LEFT JOIN (SELECT * FROM iv WHERE pred = 'R') s
              ON r.analysis_id = s.analysis_id AND r.ef <= s.sf)
    SELECT analysis_id AS r_analysis_id, arg2 AS r_arg2, arg1 AS r_arg1, sf AS r_sf, ef AS r_ef,
           s_arg2, s_sf FROM nxt WHERE rn = 1""")
def bef_unbounded_first_match(v: Views):
    left = v.side("A", "r_").drop("r_pred")
    return first_after(left, v.side("R", "s_"), on=ON, left_end="r_ef", right_start="s_sf",
                       payload="s_arg2")


@registry.query(with_views("iv") + """
    SELECT r.analysis_id, r.arg1, r.arg2 AS r_arg2, r.sf AS r_sf, r.ef AS r_ef, s.arg2 AS s_arg2,
           s.sf AS s_sf, s.ef AS s_ef FROM iv r JOIN iv s
    ON r.analysis_id = s.analysis_id AND r.arg1 = s.arg1
    WHERE r.pred = 'A' AND s.pred = 'R' AND r.ef <= s.sf""")
def bef_unbounded_same_participant(v: Views):
    rows = temporal_join(v.side("A", "r_"), v.side("R", "s_"), Temporal("Bef"),
                         on=[*ON, ("r_arg1", "s_arg1")], left_bounds=R, right_bounds=S)
    return rows.select(F.col("r_analysis_id").alias("analysis_id"), F.col("r_arg1").alias("arg1"),
                       "r_arg2", "r_sf", "r_ef", "s_arg2", "s_sf", "s_ef")


@registry.query(_pairs_sql(
    "(r.ef <= s.sf AND s.sf - r.ef <= 30 OR s.ef <= r.sf AND r.sf - s.ef <= 30 OR "
    "r.sf < s.ef AND s.sf < r.ef)",
    """, CASE WHEN r.ef <= s.sf THEN 'Bef' WHEN s.ef <= r.sf THEN 'Aft'
       WHEN s.sf <= r.sf AND r.ef <= s.ef THEN 'DJ' WHEN r.sf <= s.sf AND s.ef <= r.ef THEN 'RDJ'
       WHEN r.sf <= s.sf AND s.sf < r.ef AND r.ef <= s.ef THEN 'LOJ'
       WHEN s.sf <= r.sf AND r.sf < s.ef AND s.ef <= r.ef THEN 'ROJ' ELSE 'UNKNOWN' END AS operator,
       CASE WHEN r.ef <= s.sf THEN s.sf - r.ef WHEN s.ef <= r.sf THEN r.sf - s.ef
            ELSE abs(r.sf - s.sf) END AS delta,
       CASE WHEN r.ef <= s.sf OR s.ef <= r.sf THEN NULL ELSE abs(s.ef - r.ef) END AS epsilon"""))
def classify_near_pairs(v: Views):
    """Pairs at most 30 apart, with their most specific operator."""
    rs, re, ss, se = (F.col(c) for c in (*R, *S))
    # Every such pair starts within 30 plus the longer interval of each other:
    # a Bef, an Aft and an overlap part, which exclude each other.
    before = _pairs(v, Temporal("Bef", delta=30)).select(*PAIR)
    after = _pairs(v, Temporal("Aft", delta=30)).where(~(re <= ss)).select(*PAIR)
    starts = _pairs(v, Temporal("SP"), where=(rs < se) & (ss < re)).select(*PAIR)
    started = temporal_join(v.side("R", "s_"), v.side("A", "r_"), Temporal("SP", zeta="<"),
                            on=[(b, a) for a, b in ON], left_bounds=S, right_bounds=R,
                            where=(rs < se) & (ss < re)).select(*PAIR)
    rows = before.union(after).union(starts).union(started)
    return rows.withColumn("c", classify_pair(rs, re, ss, se)).select(*PAIR, "c.*")


@registry.query(_pairs_sql(predicate_sql("LOJ"), """,
    greatest(s.sf - r.sf, 0) AS sp_delta, greatest(r.ef - s.ef, 0) AS ef_epsilon"""))
def forced_offsets(v: Views):
    rows = _pairs(v, Temporal("LOJ")).select(*PAIR)
    return rows.withColumn("sp_delta", start_offset(F.col("r_sf"), F.col("s_sf"))).withColumn(
        "ef_epsilon", end_offset(F.col("r_ef"), F.col("s_ef")))


# -- thresholds as data -----------------------------------------------------

@registry.query(with_views("iv") + """
    SELECT r.analysis_id AS r_analysis_id, r.arg2 AS r_arg2, r.sf AS r_sf, r.ef AS r_ef,
           s.arg2 AS s_arg2, s.sf AS s_sf, p.p_size AS delta
    FROM iv r JOIN part p ON r.analysis_id = p.p_partkey JOIN iv s ON r.analysis_id = s.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND CASE WHEN p.p_size % 2 = 0 THEN r.ef < s.sf + p.p_size % 3
      ELSE r.ef <= s.sf + p.p_size % 3 END AND s.sf - r.ef <= p.p_size + p.p_size % 3""")
def bef_thresholds_per_recording(v: Views):
    limits = v.table("part").select(
        F.col("p_partkey").alias("p_id"), F.col("p_size").alias("delta"),
        F.when(F.col("p_size") % 2 == 0, "<").otherwise("<=").alias("zeta"),
        (F.col("p_size") % 3).alias("rho"))
    left = v.side("A", "r_").join(limits, F.col("r_analysis_id") == F.col("p_id"))
    spec = Temporal("Bef", delta=F.col("delta"), zeta=F.col("zeta"), rho=F.col("rho"))
    return temporal_join(left, v.side("R", "s_"), spec, on=ON, left_bounds=R,
                         right_bounds=S).select(
        "r_analysis_id", "r_arg2", "r_sf", "r_ef", "s_arg2", "s_sf", "delta")


@registry.query(with_views("iv") + """
    SELECT r.analysis_id AS r_analysis_id, r.arg2 AS r_arg2, r.ef AS r_ef, s.arg2 AS s_arg2, s.sf AS s_sf
    FROM iv r JOIN part p ON r.analysis_id = p.p_partkey JOIN iv s ON r.analysis_id = s.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND r.ef <= s.sf AND (p.p_size % 5 = 0 OR s.sf - r.ef <= p.p_size)""")
def bef_thresholds_partly_unbounded(v: Views):
    """Some recordings have no threshold, some one beyond the buckets' bound; both keep all their pairs."""
    limits = v.table("part").select(
        F.col("p_partkey").alias("p_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("delta"))
    left = v.side("A", "r_").join(limits, F.col("r_analysis_id") == F.col("p_id"))
    return temporal_join(left, v.side("R", "s_"), Temporal("Bef", delta=F.col("delta"), bucket_delta=20), on=ON,
                         left_bounds=R, right_bounds=S).select("r_analysis_id", "r_arg2", "r_ef", "s_arg2", "s_sf")


@registry.query(with_views("iv") + """
    SELECT r.analysis_id AS r_analysis_id, r.arg2 AS r_arg2, r.ef AS r_ef, s.arg2 AS s_arg2, s.sf AS s_sf
    FROM iv r JOIN part p ON p.p_partkey = r.analysis_id JOIN iv s ON r.analysis_id = s.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND CASE WHEN p_size % 2 = 0 THEN r.ef < s.sf + p_size % 4 ELSE r.ef <= s.sf + p_size % 4 END
      AND (p_size % 5 = 0 OR s.sf - r.ef <= p_size + p_size % 4)""")
def bef_own_tolerance_and_strictness(v: Views):
    """Delta (some without bound), tolerance and strictness are columns of the left rows."""
    limits = v.table("part").select(
        F.col("p_partkey").alias("p_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("delta"),
        (F.col("p_size") % 4).alias("rho"), F.when(F.col("p_size") % 2 == 0, "<").otherwise("<=").alias("zeta"))
    left = v.side("A", "r_").join(limits, F.col("r_analysis_id") == F.col("p_id"))
    spec = Temporal("Bef", delta=F.col("delta"), rho=F.col("rho"), zeta=F.col("zeta"))
    return temporal_join(left, v.side("R", "s_"), spec, on=ON, left_bounds=R, right_bounds=S).select(
        "r_analysis_id", "r_arg2", "r_ef", "s_arg2", "s_sf")


@registry.query(with_views("iv") + """
    SELECT d.delta, count(*) AS n_pairs FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id
    JOIN (SELECT unnest([5, 10, 20, 40]) AS delta) d ON true
    WHERE r.pred = 'A' AND s.pred = 'R' AND r.ef <= s.sf AND s.sf - r.ef <= d.delta
    GROUP BY d.delta""")
def bef_delta_sweep(v: Views):
    """Several deltas in one pass: join once at the largest, then fan out the matches."""
    deltas = [5, 10, 20, 40]
    pairs = _pairs(v, Temporal("Bef", delta=max(deltas)))
    met = F.filter(F.array(*[F.lit(d) for d in deltas]),
                   lambda d: F.col("s_sf") - F.col("r_ef") <= d)
    return pairs.select(F.explode(met).alias("delta")).groupBy("delta").agg(
        F.count(F.lit(1)).alias("n_pairs"))


# -- chains -----------------------------------------------------------------

def _labelled(v: Views, pred: str):
    return v.iv.where(F.col("pred") == pred).select("analysis_id", "arg1", "arg2", "sf", "ef")


@registry.query(with_views("iv") + f"""
    SELECT r.analysis_id, r.sf AS start_frame, t.ef AS end_frame, r.arg1 AS M1_arg1, r.arg2 AS M1_arg2,
           r.sf AS M1_sf, r.ef AS M1_ef, s.arg1 AS M2_arg1, s.arg2 AS M2_arg2, s.sf AS M2_sf,
           s.ef AS M2_ef, t.arg1 AS M3_arg1, t.arg2 AS M3_arg2, t.sf AS M3_sf, t.ef AS M3_ef
    FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id JOIN iv t ON s.analysis_id = t.analysis_id
    WHERE r.pred = 'A' AND s.pred = 'R' AND t.pred = 'N' AND {predicate_sql('Bef', 60)}
      AND {predicate_sql('SP', 40, r='s', s='t')} AND r.arg1 <> t.arg1""")
def chain_of_three(v: Views):
    rows = chain([_labelled(v, p) for p in "ARN"],
                 [Temporal("Bef", delta=60), Temporal("SP", delta=40)],
                 [Condition("M1.arg1", "!=", "M3.arg1")])
    return default_projection(rows, 3)


@registry.query(with_views("iv") + """
    SELECT r.analysis_id, r.arg1 AS M1_arg1, r.sf AS M1_sf, s.ef AS M2_ef FROM iv r JOIN iv s
    ON r.analysis_id = s.analysis_id AND r.arg1 = s.arg1
    WHERE r.pred = 'A' AND s.pred = 'R' AND r.ef <= s.sf AND s.ef - r.sf >= 100 AND r.arg2 < s.arg2
      AND r.ef - r.sf <= 40""")
def chain_cross_conditions(v: Views):
    rows = chain([_labelled(v, "A"), _labelled(v, "R")], [Temporal("Bef")],
                 [Condition("M1.arg1", "=", "M2.arg1"), Condition("M1.arg2", "<", "M2.arg2"),
                  Duration("M2", "M1", ">=", 100), Duration("M1", "M1", "<=", 40)])
    return project(rows, "M1.arg1", "M1.sf", "M2.ef")


@registry.query(with_views("iv") + f""",
    g AS (SELECT r.analysis_id, r.arg1 AS a1, s.arg1 AS a2, least(r.sf, s.sf) AS sf,
            greatest(r.ef, s.ef) AS ef FROM iv r JOIN iv s ON r.analysis_id = s.analysis_id
          WHERE r.pred = 'R' AND s.pred = 'N' AND {predicate_sql('SP', 40)} AND r.arg1 <> s.arg1)
    SELECT r.analysis_id, r.arg1 AS M1_arg1, g.a1 AS M2_M1_arg1, g.a2 AS M2_M2_arg1, r.sf AS M1_sf,
           g.sf AS M2_sf, g.ef AS M2_ef FROM iv r JOIN g ON r.analysis_id = g.analysis_id
    WHERE r.pred = 'A' AND r.ef <= g.sf AND g.sf - r.ef <= 60""")
def grouped_sub_chain(v: Views):
    inner = chain([_labelled(v, "R"), _labelled(v, "N")], [Temporal("SP", delta=40)],
                  [Condition("M1.arg1", "!=", "M2.arg1")])
    rows = chain([_labelled(v, "A"), as_interval(inner, 2)], [Temporal("Bef", delta=60)])
    return project(rows, "M1.arg1", "M2.M1_arg1", "M2.M2_arg1", "M1.sf", "M2.sf", "M2.ef").select(
        "analysis_id", "M1_arg1", "M2_M1_arg1", "M2_M2_arg1", "M1_sf", "M2_sf", "M2_ef")


@registry.query(with_views("vpi", "vp") + """
    SELECT i.analysis_id, a.class_id AS M1_person, b.class_id AS M1_person2, i.sf AS M1_sf, i.ef AS M1_ef
    FROM vpi i JOIN vp a ON a.relation_id = i.relation_id JOIN vp b ON b.relation_id = i.relation_id
    WHERE i.relation_type = 'physical_altercation' AND a.class = 'person' AND b.class = 'person'""")
def participant_slots_labelled(v: Views):
    """Two slots of one class: both orders and self pairs, named by class."""
    selection = pick("physical_altercation", arg1="person", arg2="person")
    refs = ["M1.arg1", "M1.arg2", "M1.sf", "M1.ef"]
    rows = project(chain([select_intervals(selection, v.visual, v.audio)], []), *refs)
    return rows.toDF("analysis_id", *class_labels(refs, [selection]))
