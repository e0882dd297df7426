"""The bound on what two texts can align refuses no pair that aligns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import near_dedup as nd


def test_no_pair_that_aligns_is_refused(spark):
    draw = np.random.default_rng(5)
    rows = []
    for n in (1, 5, 20, 41, 100, 400, 3000):
        for share in (0.0, 0.05, 0.15, 0.2, 0.3, 0.6):
            for vocabulary in (8, 500, 1 << 40):
                a = draw.integers(0, vocabulary, n).astype(np.uint64)
                b = np.where(draw.random(n) < share, draw.integers(0, vocabulary, n).astype(np.uint64), a)
                b = np.delete(b, draw.integers(0, n, int(n * share / 3)))
                rows.append((len(a), len(b), nd.held_bits(a).tolist(), nd.held_bits(b).tolist(),
                             nd.aligned(a.astype("<u4"), b.astype("<u4"))))
    table = spark.createDataFrame(rows, "n_a int, n_b int, held_a array<long>, held_b array<long>, share double")
    may = nd.may_align(*[F.col(c) for c in ("n_a", "n_b", "held_a", "held_b")])
    out = table.select("share", may.alias("may")).collect()
    assert all(r.may for r in out if r.share >= nd.LEAST)
    assert sum(not r.may for r in out) > len(out) / 4
    # Without bits nothing is refused.
    assert table.withColumn("held_a", F.lit(None).cast("array<long>")).where(may & (F.col("n_a") == F.col("n_b"))).count() \
        == table.where("n_a = n_b").count()
