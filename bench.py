"""Headline queries at one scale; prints one JSON line.

Each query is run once to warm up and then three times; the median counts.  The
result is written to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from spanloom.operators.islands import coalesce_audio, frames_to_intervals, merge_close  # noqa: E402
from spanloom.operators.temporal import Temporal, temporal_join  # noqa: E402
from spanloom.plans.registry import load_all  # noqa: E402
from spanloom.plans.views import Views  # noqa: E402
from spanloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

ON = [("r_analysis_id", "s_analysis_id")]
PAIRS = {"SP": (30, None), "EF": (None, 30), "DJ": (30, 30), "RDJ": (30, 30), "LOJ": (30, 30),
         "ROJ": (30, 30)}


def pairs(v: Views, op: str, delta, epsilon, strategy: str) -> DataFrame:
    return temporal_join(v.side("A", "r_"), v.side("R", "s_"), Temporal(op, delta, epsilon), on=ON,
                         left_bounds=("r_sf", "r_ef"), right_bounds=("s_sf", "s_ef"),
                         strategy=strategy)


def long_pairs(v: Views, op: str, delta, epsilon) -> DataFrame:
    """All intervals as one recording, laid out one after another in time."""
    step = F.col("analysis_id") * 4000
    one = v.iv.select(F.lit(0).alias("analysis_id"), "pred", (F.col("sf") + step).alias("sf"),
                      (F.col("ef") + step).alias("ef"))
    left = one.where("pred = 'A'").toDF("r_analysis_id", "r_pred", "r_sf", "r_ef")
    right = one.where("pred = 'R'").toDF("s_analysis_id", "s_pred", "s_sf", "s_ef")
    return temporal_join(left, right, Temporal(op, delta, epsilon), on=ON,
                         left_bounds=("r_sf", "r_ef"), right_bounds=("s_sf", "s_ef"))


def session_variant(v: Views) -> DataFrame:
    """The batch coalescing expressed with session windows, for comparison."""
    rows = v.audio.withColumn("ts", F.timestamp_seconds("sf"))
    gap = F.concat((F.col("ef") - F.col("sf") + 60).cast("string"), F.lit(" seconds"))
    return rows.groupBy("analysis_id", "audio_class", F.session_window("ts", gap)).agg(
        F.min("sf").alias("sf"), F.max("ef").alias("ef"), F.max("confidence").alias("confidence"))


def headline(v: Views) -> dict[str, callable]:
    registered = load_all().queries

    def named(name: str):
        return lambda: registered[name](v.spark, v.sf_dir)

    out = {
        "bef_recording": lambda: pairs(v, "Bef", 30, None, "recording"),
        "bef_bucketed": lambda: pairs(v, "Bef", 30, None, "auto"),
    }
    for op, (delta, epsilon) in PAIRS.items():
        out[f"{op.lower()}_recording"] = lambda o=op, d=delta, e=epsilon: pairs(v, o, d, e, "recording")
    out["bef_one_long_recording"] = lambda: long_pairs(v, "Bef", 30, None)
    for op, (delta, epsilon) in PAIRS.items():
        out[f"{op.lower()}_one_long_recording"] = lambda o=op, d=delta, e=epsilon: long_pairs(v, o, d, e)
    out["sp_unbounded_one_long_recording"] = lambda: long_pairs(v, "SP", None, None)
    out["frames_to_intervals"] = lambda: frames_to_intervals(
        v.frame_rel, 24, ("analysis_id", "relation_type", "class_id"))
    out["coalesce_intervals"] = lambda: merge_close(v.iv, ["analysis_id", "pred"], "sf", "ef", 30)
    out["coalesce_audio"] = lambda: coalesce_audio(v.audio.select(
        "analysis_id", "audio_class", F.col("sf").alias("start_frame"), F.col("ef").alias("end_frame"),
        "confidence"), 60)
    out["coalesce_audio_session_window"] = lambda: session_variant(v)
    for name in ("nearest_earlier_vectors", "detect_all_events", "class_metrics", "best_overlap_match",
                 "parameter_sweep", "event_metrics", "parse_object_payloads", "normalise_labels",
                 "tracked_identities"):
        out[name] = named(name)
    return out


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = set(sys.argv[1:])
    times: dict[str, float] = {}
    for name, build in headline(Views(spark, SF_DIR)).items():
        if chosen and name not in chosen:
            continue
        laps = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline query time, median of warm runs", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cores": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
