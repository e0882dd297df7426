"""Changes in place: the right rows, and no file touched that need not be."""

from __future__ import annotations

import glob
import os

from spanloom.sources import stored, tables

ROWS = "analysis_id string, k int, version long, value string"


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def table(spark, path, buckets=16):
    rows = [(f"r{i}", k, 1, f"old {i} {k}") for i in range(40) for k in range(3)]
    tables.write_table(spark.createDataFrame(rows, ROWS), path, mode="overwrite", buckets=buckets)
    return {(a, k): (v, t) for a, k, v, t in rows}


def held(spark, path):
    rows = stored.stored(spark, path).collect()
    out = {(r.analysis_id, r.k): (r.version, r.value) for r in rows}
    assert len(out) == len(rows)
    return out


def test_upsert_writes_only_the_buckets_it_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    want, before = table(spark, path), files(path)
    new = [("r1", 0, 2, "newer"), ("r1", 1, 0, "older, ignored"), ("r7", 9, 1, "added"), ("r99", 0, 1, "a new recording")]
    among = stored.upsert(spark, path, spark.createDataFrame(new, ROWS), ["analysis_id", "k"], "version", buckets=16)
    want |= {(a, k): (v, t) for a, k, v, t in new if v >= want.get((a, k), (0,))[0]}
    assert held(spark, path) == want
    after = files(path)
    kept = {f for f in before if not any(f.startswith(f"analysis_bucket={b}/") for b in among)}
    assert 0 < len(among) <= 3 and kept and {f: before[f] for f in kept} == {f: after[f] for f in kept}
    assert stored.upsert(spark, path, spark.createDataFrame([], ROWS), ["analysis_id", "k"], "version", buckets=16) == []
    assert files(path) == after


def test_delete_removes_whole_recordings(spark, tmp_path):
    path = str(tmp_path / "t")
    want = table(spark, path)
    home = {r.analysis_id: r.analysis_bucket for r in stored.stored(spark, path).select("analysis_id", "analysis_bucket").distinct().collect()}
    alone = home["r3"]
    doomed = [a for a, b in home.items() if b == alone] + ["r5", "unknown"]  # one bucket loses all its rows
    before = files(path)
    among = stored.delete(spark, [path], spark.createDataFrame([(a,) for a in doomed], "analysis_id string"), buckets=16)
    assert held(spark, path) == {k: v for k, v in want.items() if k[0] not in doomed}
    assert not os.path.isdir(f"{path}/analysis_bucket={alone}")
    after = files(path)
    kept = {f for f in before if not any(f.startswith(f"analysis_bucket={b}/") for b in among)}
    assert kept and all(before[f] == after[f] for f in kept)


def test_ids_take_the_tables_type(spark, tmp_path):
    """The bucket hashes the id as it is stored, so a change that holds it as another type meets the same bucket."""
    path = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(i, 0, 1, "old") for i in range(9)], "analysis_id long, k int, version long, value string"),
                       path, mode="overwrite", buckets=4)
    new = spark.createDataFrame([(3, 0, 2, "new")], "analysis_id int, k int, version long, value string")
    stored.upsert(spark, path, new, ["analysis_id", "k"], "version", buckets=4)
    rows = {r.analysis_id: r.value for r in stored.stored(spark, path).collect()}
    assert rows == {i: "new" if i == 3 else "old" for i in range(9)}


def test_dense_ids_have_no_gap_and_no_collision(spark):
    rows = [(f"r{i % 7}", i % 50, i % 3) for i in range(1_000)] + [(None, 1, None), (None, 1, None)]
    table = spark.createDataFrame(rows, "analysis_id string, frame int, extra int")
    for buckets in (1, 4, 1 << 16):
        out = tables.with_dense_id(table, ["analysis_id", "frame"], "n", first=10, buckets=buckets).collect()
        assert len(out) == len(rows)
        ids = {}
        for r in out:
            ids.setdefault((r.analysis_id, r.frame), set()).add(r.n)
        assert all(len(found) == 1 for found in ids.values())
        assert sorted(n for found in ids.values() for n in found) == list(range(10, 10 + len(ids)))
    again = tables.with_dense_id(table.repartition(5), ["analysis_id", "frame"], "n", first=10).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in out}


def test_participants_follow_their_intervals(spark):
    rows = [("a", "carrying", [1, 2, 2], 5, 9), ("a", "carrying", [1, 2, 2], 6, 9), ("b", "near", [], 0, 1), ("b", "near", None, 0, 1)]
    made = spark.createDataFrame(rows, "analysis_id string, relation_type string, participants array<int>, start_frame int, end_frame int")
    parents, children = tables.intervals_with_participants(made, first=100)
    starts = {r.relation_id: (r.analysis_id, r.start_frame) for r in parents.collect()}
    assert sorted(starts) == [100, 101, 102, 103]
    assert sorted((starts[r.relation_id], r.class_id) for r in children.collect()) == [
        (("a", 5), 1), (("a", 5), 2), (("a", 6), 1), (("a", 6), 2)]
