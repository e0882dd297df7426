"""The share of texts that the secret chains are learned from holds at any size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.llm.secret_scan import last_picked


@pytest.mark.parametrize("n", [0, 1, 20_000])
def test_small_tables_are_taken_whole(n):
    assert last_picked(20_000, n) == (1 << 63) - 1


@pytest.mark.parametrize("n", [10**6, 10**9, 2 * 10**10, 10**13])
def test_the_sample_does_not_vanish(n):
    hashes = last_picked(20_000, n) + (1 << 63) + 1  # so many of 2**64 are picked
    assert abs(hashes * n / 2**64 - 20_000) < 0.01


def test_about_so_many_rows(spark):
    rows = spark.range(50_000).where(F.xxhash64(F.col("id"), F.lit("secrets")) <= F.lit(last_picked(5_000, 50_000)))
    assert 4_700 < rows.count() < 5_300
