"""Declared schemas of the stored tables and of the JSON documents they hold."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


PARTICIPANT = _struct(class_id=T.IntegerType(), **{"class": T.StringType()})

ANALYSES = _struct(
    analysis_id=T.StringType(), condition=T.StringType(), sampling_rate=T.IntegerType(),
    fps=T.IntegerType(), grid_rows=T.IntegerType(), grid_cols=T.IntegerType(),
    created_at=T.TimestampType(),
)
VISUAL_PER_FRAME = _struct(
    analysis_id=T.StringType(), frame=T.LongType(), class_id=T.IntegerType(),
    **{"class": T.StringType()}, block=T.IntegerType(), description=T.StringType(),
)
VISUAL_RELATION = _struct(
    analysis_id=T.StringType(), frame=T.LongType(), relation_id=T.IntegerType(),
    relation_type=T.StringType(), class_id=T.IntegerType(),
)
VISUAL_PER_INTERVAL = _struct(
    relation_id=T.LongType(), analysis_id=T.StringType(), start_frame=T.LongType(),
    end_frame=T.LongType(), relation_type=T.StringType(),
)
VISUAL_PARTICIPANT = _struct(
    relation_id=T.LongType(), class_id=T.IntegerType(), **{"class": T.StringType()},
)
AUDIO_PER_INTERVAL = _struct(
    audio_interval_id=T.LongType(), analysis_id=T.StringType(), start_frame=T.LongType(),
    end_frame=T.LongType(), audio_class=T.StringType(), confidence=T.DoubleType(),
)
EVENT_SPEC = _struct(id=T.StringType(), condition=T.StringType(), model_json=T.StringType())
APP_CONFIG = _struct(key=T.StringType(), value_json=T.StringType())
OBJECT_MEMORY = _struct(
    analysis_id=T.StringType(), frame=T.LongType(), class_id=T.IntegerType(),
    **{"class": T.StringType()}, blocks=T.ArrayType(T.IntegerType()),
    description=T.StringType(), embedding=T.ArrayType(T.FloatType()),
)
GROUND_TRUTH = _struct(
    scene=T.IntegerType(), modality=T.StringType(), **{"class": T.StringType()},
    start_s=T.DoubleType(), end_s=T.DoubleType(),
)
EXPECTED_EVENTS = _struct(scene=T.IntegerType(), event=T.StringType(), audio=T.StringType())

TABLES = {
    "analyses": ANALYSES,
    "visual_per_frame": VISUAL_PER_FRAME,
    "visual_relation": VISUAL_RELATION,
    "visual_per_interval": VISUAL_PER_INTERVAL,
    "visual_participant": VISUAL_PARTICIPANT,
    "audio_per_interval": AUDIO_PER_INTERVAL,
    "event_spec": EVENT_SPEC,
    "app_config": APP_CONFIG,
    "object_memory": OBJECT_MEMORY,
    "ground_truth": GROUND_TRUTH,
    "expected_events": EXPECTED_EVENTS,
}

# Per-pair operator parameters inside an event document:
# {"0": {"delta": "delta_visual_x", "zeta": "<="}, ...}.
EVENT_MODEL = _struct(
    delta_map=T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())),
)
