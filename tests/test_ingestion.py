from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as fx, time as ft
from spanloom.operators import ingest, thresholds
from spanloom.sources import tables
from spanloom.vocab import AUDIO_KEYWORDS, RELATION_SIGNATURES

PAYLOADS = [
    (1, '[{"class": "person", "blocks": [1, 2, 2], "id": 4}]'),
    (2, 'Sure:\n```json\n{"objects": [{"class": "vehicle", "blocks": 3}]}\n```'),
    (3, '{"result": {"objects": [{"class": "object", "blocks": "left", "id": "new"}]}}'),
    (4, '[{"blocks": [1]}, {"class": ""}, {"class": "person"}, 7]'),
    (5, "[{broken"),
    (6, ""),
    (7, None),
    (8, '{"note": "nothing"}'),
    (9, "[]"),
    (10, '```\n[{"class": "person", "blocks": [1.0, "2", "x"]}]'),
]


def test_object_payloads(spark):
    df = spark.createDataFrame(PAYLOADS, "frame int, response string")
    objects, rejected = ingest.parse_objects(df)
    got = {(r.frame, r.ordinal, r.raw_id, r["class"], tuple(r.blocks)) for r in objects.collect()}
    assert got == {
        (1, 0, "4", "person", (1, 2, 2)), (2, 0, "new", "vehicle", (3,)), (3, 0, "new", "object", ()),
        (4, 2, "new", "person", ()), (10, 0, "new", "person", (2,))}
    assert sorted(r.frame for r in rejected.collect()) == [5, 8]
    assert ingest.expand_blocks(objects).where("frame = 1").count() == 2


def test_relations(spark):
    text = "Running( 2 ) carrying(1,3) carrying(2, 3)\nflying(1) none() enter_or_exit_vehicle(1, 9) carrying(1"
    payload = spark.createDataFrame([("a", 0, text)], "analysis_id string, frame int, response string")
    vocabulary = spark.createDataFrame(list(RELATION_SIGNATURES.items()), "name string, signature string")
    objects = spark.createDataFrame([("a", 0, 1, "person"), ("a", 0, 2, "person"), ("a", 0, 3, "object")],
                                    "analysis_id string, frame int, class_id int, class string")
    parsed = ingest.parse_relations(payload)
    assert [(r.relation_id, r.relation_type, r.args) for r in parsed.orderBy("relation_id").collect()] == [
        (1, "running", ["2"]), (2, "carrying", ["1", "3"]), (3, "carrying", ["2", "3"]),
        (4, "flying", ["1"]), (5, "none", [""]), (6, "enter_or_exit_vehicle", ["1", "9"])]
    assert ingest.keep_vocabulary(parsed, vocabulary).count() == 4
    gated = ingest.gate_participants(parsed, vocabulary, objects)
    stored = ingest.store_once(gated)
    # The second carrying of object 3 in a frame is not stored again.
    assert sorted((r.relation_type, r.class_id, r.relation_id) for r in stored.collect()) == [
        ("carrying", 1, 2), ("carrying", 2, 3), ("carrying", 3, 2), ("enter_or_exit_vehicle", 1, 6),
        ("running", 2, 1)]
    assert ingest.store_once(gated, per_relation=True).count() == 6


LABELS = [
    ("Glass Breaking!", "glass_breaking"), ("screaming", "shout"), ("a loud bang, maybe", "impact"),
    ("tire squeal", "tire_squeal"), ("honking", "horn"), ("cars", "engine"), ("shattering", "glass_breaking"),
    ("music", None), ("", None), (None, None), ("x", "x"), ("gunshots.", "gunshot_or_explosion"),
    ("some-explosions", "gunshot_or_explosion"),
]


def test_label_normalisation(spark):
    rows = [(c, k, i) for i, (c, k) in enumerate((c, k) for c, ks in AUDIO_KEYWORDS.items() for k in ks)]
    synonyms = ingest.synonym_table(spark.createDataFrame(rows, "class string, keyword string, ordinal int"))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELS)], "i int, t string")
    got = {r.i: r.c for r in ingest.normalise_labels(df, synonyms, "t", "c").collect()}
    assert [got[i] for i in range(len(LABELS))] == [c for _, c in LABELS]


def stem(word):
    """The suffix list tried in order."""
    w = word.lower().strip("_.,;:!?")
    for suffix in ("ing", "ed", "ly", "s", "es", "ies", "ness", "tion"):
        if w.endswith(suffix) and len(w) > len(suffix) + 2:
            return w[: -len(suffix)]
    return w


def test_stem(spark):
    words = ["shouting", "Crashes", "ness", "gas", "ed", "bed", "flies", "wetness", "explosion", "nation",
             "station", "sing", "ring", "running!", "_quickly_", "as", "ties", "es", "bus", "aaas", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", fx.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: stem(w) for w in words}


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(ft.seconds_to_frames(F.lit(v), F.lit(1))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert get(ft.clock_text(F.lit(75.5))) == "1:15.50"
    assert get(ft.clock_text(F.lit(3675.25))) == "1:01:15.25"
    assert get(ft.frame_rate(F.lit("0/0"), F.lit("30000/1001"))) == 29
    assert get(ft.frame_rate(F.lit("x"), F.lit(None).cast("string"))) == 24
    box = get(fx.block_box(F.array(F.lit(2), F.lit(7)), 2, 4, F.lit(1280), F.lit(720)))
    assert tuple(box) == (320, 0, 960, 720)
    empty = get(fx.block_box(F.array().cast("array<int>"), 2, 4, F.lit(1280), F.lit(720)))
    assert tuple(empty) == (0, 0, 1280, 720)
    assert get(F.array_join(ingest.allowed_classes(F.lit("(VehicleID?, ObjectID2)")), ",")) == "vehicle,object"


def test_thresholds_are_checked(spark):
    rows = spark.createDataFrame([("delta_visual_a", "delta", "∞"), ("rho_audio_a", "rho", "2"),
                                  ("zeta_visual_a", "zeta", "<")], "name string, key_kind string, value string")
    got = {r.name: (r.number, r.strictness) for r in thresholds.resolve(rows).collect()}
    assert got == {"delta_visual_a": (None, None), "rho_audio_a": (2, None), "zeta_visual_a": (None, "<")}
    odd = rows.withColumn("value", F.lit("=="))
    with pytest.raises(Exception, match="invalid strictness"):
        thresholds.resolve(odd.where("key_kind = 'zeta'")).collect()
    with pytest.raises(Exception, match="not a whole number"):
        thresholds.resolve(odd.where("key_kind = 'delta'")).collect()


def test_storage_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"run{i % 5}", i, i + 3, "running") for i in range(50)],
                                 tables.TABLES["visual_per_interval"])
    path = str(tmp_path / "vpi")
    tables.write_table(rows, path, buckets=8)
    back = tables.read_table(spark, path, "visual_per_interval")
    assert back.count() == 50
    stored = spark.read.parquet(path)
    picked = tables.scan(stored, ["run1", "run4"], buckets=8)
    assert picked.count() == 20
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "analysis_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_export_by_scene(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"e{i}") for i in range(9)], "scene int, event string")
    for fmt in ("json", "csv", "parquet"):
        path = str(tmp_path / fmt)
        tables.export_by(rows, path, fmt=fmt)
        assert sorted(p.name for p in (tmp_path / fmt).glob("scene=*")) == ["scene=0", "scene=1", "scene=2"]
        assert spark.read.format(fmt).load(path).count() == 9


def test_keep_first_is_stable_under_copies(spark):
    rows = spark.createDataFrame([(1, i % 3, f"v{i}") for i in range(9)] * 50, "k int, o int, v string")
    got = tables.keep_first(rows, ["k"], ["o"]).collect()
    assert [(r.k, r.o, r.v) for r in got] == [(1, 0, "v0")]
