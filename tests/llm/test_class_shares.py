"""Scores do not depend on whether the bounds of the training rows bind."""

from __future__ import annotations

from spanloom.llm import toxicity


def test_bounded_training_keeps_the_odds(spark, monkeypatch):
    texts = [(k, f"you idiot number {k}" if k % 3 else f"plain words {k}", 1) for k in range(60)]
    texts += [(k, f"someone said idiot {k}" if k % 10 == 0 else f"plain clean words {k}", 0) for k in range(60, 1_260)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int").coalesce(1)
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda *_: toxicity.Lexicon())  # the curve alone is looked at
    whole = toxicity.learn(docs, labels).curve
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 100)
    bounded = toxicity.learn(docs, labels).curve
    assert abs(whole[0] - bounded[0]) < 0.4  # without weights about log(9)
