"""Vectors as whole numbers, for the operators that count on exact sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import stored

SCALE = 1024
# Beyond this size a component has no 1024-fold that a long holds exactly.
LARGEST = float(1 << 52)


def whole_vectors(vectors: DataFrame, purpose: str, offset: int = 0, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(rows, number of rows, dimension): row_id, vec_id, ``keep`` and x (array of longs), written once.

    x is floor(1024 * component) + ``offset``.  Left out are vectors that are null or empty,
    hold null or non-finite components or such as no long holds (2**52 and more), and those
    of another length than most have (of equally many, the longer).  ``row_id`` is unique: a
    number of the part in its upper bits, the place in it in the lower 33.
    """
    raw = vectors.select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("raw")).where(
        (F.size("raw") > 0) & F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    rows = stored(raw.select(
        F.monotonically_increasing_id().alias("row_id"), "vec_id", *keep,
        F.transform("raw", lambda c: F.floor(c * SCALE).cast("long") + F.lit(offset)).alias("x")), purpose)
    usual = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("dim")).first()
    if usual is None:
        return rows, 0, 0
    return rows.where(F.size("x") == usual["dim"]), usual["n"], usual["dim"]
