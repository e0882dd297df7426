"""Few links cost few tasks, however many shuffle partitions there are."""

from __future__ import annotations

from spanloom.llm.components import components


def test_links_are_not_spread_over_all_partitions_again(spark):
    """Two chains of five; without adaptive merging, as each step reads what the last one left."""
    links = spark.createDataFrame([(i, i + 1) for k in (0, 10) for i in range(k, k + 4)], "a long, b long")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, components(links).collect()))
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i is not None]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == [(i, k) for k in (0, 10) for i in range(k, k + 5)]
    tasks = sum(i.numCompletedTasks for i in infos)
    assert tasks < 600
