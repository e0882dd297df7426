"""Equal texts of two deliveries are one group though their ids have other texts too."""

from __future__ import annotations

from spanloom.llm import exact_dedup


def test_other_texts_of_an_id_do_not_part_copies(spark, tmp_path):
    rows = [(k, t) for k in range(12) for t in ("Same text", f"other {k}")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.deduplicate(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(got) == 24
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == sorted([(11, 12)] * 12 + [(k, 1) for k in range(12)])
