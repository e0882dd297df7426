"""A product stays alive in the JVM until its rows are taken."""

from __future__ import annotations

import time

import numpy as np
from pyspark.mllib.common import JavaModelWrapper

from spanloom.llm.whitening import block_matrix, projected


def test_a_slow_call_finds_its_matrix(spark, monkeypatch):
    """Freed matrices leave the JVM from another thread; here the caller waits until that thread is done."""
    freed = JavaModelWrapper.__del__
    monkeypatch.setattr(JavaModelWrapper, "__del__", lambda model: (freed(model), time.sleep(0.5)))
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "index long, values array<double>")
    got = projected(block_matrix(rows, "values", 2, 2), np.array([[1.0], [10.0]]))
    assert sorted(map(tuple, got.collect())) == [(0, [21.0]), (1, [43.0])]
