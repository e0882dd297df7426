"""The pipeline's stages one after another, against a plain replay of their decisions."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from spanloom.llm import near_dedup, secret_scan, toxicity

SF_DIR = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not mounted")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    columns, before = docs.columns, rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).where("predicted = 1").collect()}
            assert set(rows(after)) == set(before) - toxic and toxic
        elif name == "exact_dedup":
            best: dict[str, int] = {}
            for i, r in before.items():
                key = (r["text"] or "").encode().lower().decode()
                best[key] = max(i, best.get(key, i))
            assert set(rows(after)) == set(best.values())
        elif name == "near_dedup":
            classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
            assert set(rows(after)) == set(classes.values()) and len(set(classes.values())) < len(classes)
        elif name == "secret_scan":
            chains = secret_scan.learn(docs)
            got = rows(after)
            assert set(got) == set(before)
            for i, r in before.items():
                assert (got[i]["text"] == r["text"]) == (not secret_scan.spans_of(r["text"] or "", chains))
                assert not secret_scan.base_spans(got[i]["text"] or "")
        else:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            docs, before = after, rows(after)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))
