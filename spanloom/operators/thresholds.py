"""Operator parameters as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.time import seconds_to_frames, unbounded
from spanloom.schema import EVENT_MODEL
from spanloom.vocab import MODALITIES, PARAMETER_KINDS, STRICTNESS

_NAMED = "^({})_({})_".format("|".join(PARAMETER_KINDS), "|".join(MODALITIES))
# What an unset parameter means.
DEFAULTS = {"delta": "inf", "epsilon": "inf", "zeta": "<=", "eta": "<=", "rho": "0"}


def explode_parameters(specs: DataFrame) -> DataFrame:
    """(event, condition, pair, kind, value) from the event documents."""
    model = F.from_json("model_json", EVENT_MODEL)
    pairs = specs.select(F.col("id").alias("event"), "condition",
                         F.explode(model["delta_map"]).alias("pair", "__entry"))
    return pairs.select("event", "condition", "pair", F.explode("__entry").alias("kind", "value"))


def key_parts(value: Column) -> tuple[Column, Column]:
    """(kind, modality) from the prefix of a named key, NULL for a literal."""
    named = value.rlike(_NAMED)
    return (F.when(named, F.regexp_extract(value, _NAMED, 1)),
            F.when(named, F.regexp_extract(value, _NAMED, 2)))


def named_parameters(parameters: DataFrame) -> DataFrame:
    kind, modality = key_parts(F.col("value"))
    return parameters.where(F.col("value").rlike(_NAMED)).select(
        "event", "condition", F.col("value").alias("name"), kind.alias("key_kind"),
        modality.alias("modality"))


def required_parameters(parameters: DataFrame) -> DataFrame:
    """Distinct (condition, name); literals such as ``<=`` are not names."""
    return named_parameters(parameters).select("condition", "name").distinct()


def missing_parameters(required: DataFrame, provided: DataFrame) -> DataFrame:
    return required.join(provided.select("name").distinct(), "name", "left_anti")


def with_defaults(parameters: DataFrame, authored: DataFrame) -> DataFrame:
    """Value of each named parameter: the authored literal, else the kind's default."""
    default = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])
    names = named_parameters(parameters).select("name", "key_kind").distinct()
    return names.join(authored.select("name", F.col("literal").alias("__lit")), "name", "left").select(
        "name", "key_kind", F.coalesce("__lit", F.element_at(default, F.col("key_kind"))).alias("value"))


def resolve(values: DataFrame) -> DataFrame:
    """Split text values into ``number`` (NULL = unbounded) and a checked ``strictness``."""
    strict = F.col("key_kind").isin("zeta", "eta")
    valid = F.col("value").isin(*STRICTNESS)
    checked = F.when(valid, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("invalid strictness for "), F.col("name"))).cast("string"))
    return values.withColumn("number", F.when(~strict, unbounded(F.col("value")))).withColumn(
        "strictness", F.when(strict, checked))


def overlay(base: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base settings with non-null overrides on top; override-only keys are added."""
    top = overrides.where(F.col("value").isNotNull()).select(
        *keys, F.col("value").alias("__override"))
    return base.join(top, list(keys), "full").select(
        *keys, F.coalesce("__override", "value").alias("value"))


def in_frames(parameters: DataFrame, runs: DataFrame) -> DataFrame:
    """Seconds to frames by each recording's own rate, half-even."""
    return parameters.join(runs.select("analysis_id", "fps"), "analysis_id").withColumn(
        "frames", seconds_to_frames(F.col("seconds"), F.col("fps")))


def operator_rows(resolved: DataFrame, keys: Sequence[str] = ("setting",), scale: Column | None = None) -> DataFrame:
    """Resolved parameters by name, as one row for each event's operator: what ``detect_by_rows`` joins.

    ``resolved``: ``keys`` (setting, perhaps analysis_id), name such as ``delta_audio_fight``,
    number (null: unbounded) and strictness.  ``scale`` turns numbers into the intervals' unit,
    such as frames a second.  A kind without a row has its default.
    """
    parts = [F.regexp_extract("name", _NAMED + "(.+)$", i) for i in (1, 2, 3)]
    kind, modality, event = parts
    number = F.col("number") if scale is None else F.col("number") * scale
    rows = resolved.where(F.col("name").rlike(_NAMED)).select(
        *keys, event.alias("event_id"), modality.alias("modality"), kind.alias("kind"), number.cast("double").alias("number"),
        "strictness")

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == name, F.col(value)))

    return rows.groupBy(*keys, "event_id", "modality").agg(
        of("delta", "number").alias("delta"), F.coalesce(of("zeta", "strictness"), F.lit(DEFAULTS["zeta"])).alias("zeta"),
        F.coalesce(of("rho", "number"), F.lit(float(DEFAULTS["rho"]))).alias("rho"))
