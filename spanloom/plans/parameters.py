"""Operator parameters kept as event documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import thresholds as th
from spanloom.plans.registry import Registry
from spanloom.plans.views import Views, with_views

registry = Registry()

# Every part stands for one event document with two operator pairs.
_SPECS = """WITH s AS (SELECT 'e' || p_partkey AS event, ['A', 'B', 'C'][CAST(p_size % 3 + 1 AS INT)] AS condition,
      'delta_visual_' || p_type || p_size AS k1, 'rho_audio_' || p_brand AS k2, CAST(p_size AS VARCHAR) AS lit FROM part),
    x AS (SELECT event, condition, '0' AS pair, 'delta' AS kind, k1 AS value FROM s
      UNION ALL SELECT event, condition, '0', 'zeta', '<=' FROM s
      UNION ALL SELECT event, condition, 'left.0', 'rho', k2 FROM s
      UNION ALL SELECT event, condition, 'left.0', 'epsilon', lit FROM s),
    named AS (SELECT event, condition, value AS name, kind AS key_kind,
      CASE kind WHEN 'delta' THEN 'visual' ELSE 'audio' END AS modality FROM x WHERE kind IN ('delta', 'rho'))"""


def _specs(v: Views):
    document = F.format_string(
        '{"delta_map": {"0": {"delta": "delta_visual_%s%d", "zeta": "<="}, '
        '"left.0": {"rho": "rho_audio_%s", "epsilon": "%d"}}}', "p_type", "p_size", "p_brand", "p_size")
    return v.table("part").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"),
        F.element_at(F.array(*[F.lit(c) for c in "ABC"]), (F.col("p_size") % 3 + 1).cast("int")).alias("condition"),
        document.alias("model_json"), "p_size", "p_type", "p_brand")


@registry.query(_SPECS + " SELECT * FROM x")
def explode_parameters(v: Views):
    return th.explode_parameters(_specs(v))


@registry.query(_SPECS + " SELECT DISTINCT condition, name FROM named")
def required_parameters(v: Views):
    return th.required_parameters(th.explode_parameters(_specs(v)))


@registry.query(_SPECS + " SELECT * FROM named")
def named_parameters(v: Views):
    return th.named_parameters(th.explode_parameters(_specs(v)))


# Provided: the keys of the larger parts.
_PROVIDED = """, provided AS (SELECT 'delta_visual_' || p_type || p_size AS name, p_size AS literal FROM part
      WHERE p_size >= 20)"""


def _provided(v: Views):
    return v.table("part").where("p_size >= 20").select(
        F.concat(F.lit("delta_visual_"), "p_type", F.col("p_size").cast("string")).alias("name"),
        F.col("p_size").cast("string").alias("literal")).distinct()


@registry.query(_SPECS + _PROVIDED + """
    SELECT DISTINCT name, condition FROM named WHERE name NOT IN (SELECT name FROM provided)""")
def missing_parameters(v: Views):
    required = th.required_parameters(th.explode_parameters(_specs(v)))
    return th.missing_parameters(required, _provided(v))


@registry.query(_SPECS + _PROVIDED + """
    SELECT DISTINCT n.name, n.key_kind, coalesce(CAST(p.literal AS VARCHAR),
      CASE n.key_kind WHEN 'delta' THEN 'inf' ELSE '0' END) AS value,
      CASE WHEN p.literal IS NOT NULL THEN CAST(p.literal AS INT) WHEN n.key_kind = 'rho' THEN 0 END AS number,
      CAST(NULL AS VARCHAR) AS strictness
    FROM named n LEFT JOIN (SELECT DISTINCT * FROM provided) p ON p.name = n.name""")
def resolved_parameters(v: Views):
    """Authored literals over the defaults of each kind, then typed."""
    values = th.with_defaults(th.explode_parameters(_specs(v)), _provided(v))
    return th.resolve(values)


@registry.query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS value FROM part""")
def overlay_settings(v: Views):
    base = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("value"))
    overrides = v.table("part").select(F.col("p_partkey").alias("id"), F.when(
        F.col("p_size") % 2 == 0, F.col("p_brand")).alias("value"))
    return th.overlay(base, overrides, ["id"])


@registry.query(with_views("runs") + """
    SELECT r.analysis_id, p.p_size / 8.0 AS seconds, r.fps, CAST(round_even(p.p_size / 8.0 * r.fps, 0) AS BIGINT)
      AS frames FROM runs r JOIN part p ON p.p_partkey = r.analysis_id""".replace(
    "p.p_size / 8.0 AS", "CAST(p.p_size / 8.0 AS DOUBLE) AS"))
def parameters_in_frames(v: Views):
    seconds = v.table("part").select(F.col("p_partkey").alias("analysis_id"),
                                     (F.col("p_size") / F.lit(8.0)).alias("seconds"))
    return th.in_frames(seconds, v.runs)
