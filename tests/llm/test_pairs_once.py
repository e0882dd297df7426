"""Texts that share many buckets are paired in one of them."""

from __future__ import annotations

from spanloom.llm import near_dedup


def test_a_pair_is_made_once(spark, monkeypatch):
    """Ids 1 and 2 share three buckets, 3 is in one of those with either; 4 has two lengths, and only one may align."""
    members = [(k, i, 10, i) for k in (7, 8, 9) for i in (1, 2)] + [(8, 3, 10, 3), (7, 4, 99, 4), (9, 4, 10, 4)]
    known = spark.createDataFrame(members, "key long, id long, n_words int, label long")
    parted = known.groupBy("key").count().withColumnRenamed("count", "size")
    read = spark.createDataFrame([(i, bytes([i])) for i in (1, 2, 3, 4)], "doc_id long, same binary")
    made = []
    kept = type(known).dropDuplicates
    monkeypatch.setattr(type(known), "dropDuplicates", lambda df, *of: made.append(df) or kept(df, *of))
    got = near_dedup.across(known, parted, read, None)
    want = [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2)]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, made[0].collect())) == want, "before copies of a pair are dropped"
