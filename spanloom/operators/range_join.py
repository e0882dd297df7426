"""Equi-joins that stand in for range joins.

Spark plans an inequality-only join as a nested loop, and an equi-join on the
recording alone puts one long recording into one task.  Both helpers add a time
bucket to the join key, so the shuffle spreads by (recording, bucket), while the
caller's exact condition stays as the join residual.

* ``banded_join``: the two points differ by a bounded amount.
* ``containment_join``: a point lies in a row's own range, of any length.

Neither produces a pair twice, so bag semantics survive without a DISTINCT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BUCKET = "__bucket"
_LEVEL = "__level"
# Ranges of up to 8**k frames share a bucket width of 8**k.
_LEVEL_BITS = 3


def _bucket(point: Column, width: float) -> Column:
    return F.floor(point / F.lit(width)).cast("long")


def join_rows(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]],
              residual: Column, how: str) -> DataFrame:
    """Equi-join on differently named key pairs with an extra condition."""
    condition = residual
    for lk, rk in keys:
        condition = condition & (F.col(lk) == F.col(rk))
    return left.join(right, condition, how)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]],
                residual: Column, salt: int) -> DataFrame:
    """Inner equi-join whose keys are each spread over ``salt`` tasks.

    A right row goes to one of them by a hash of its content, a left row to all.
    """
    spread = left.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    hashed = right.withColumn("__salt_r", F.pmod(F.xxhash64(*right.columns), F.lit(salt)).cast("int"))
    return join_rows(spread, hashed, [*keys, ("__salt", "__salt_r")], residual, "inner").drop(
        "__salt", "__salt_r")


def banded_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]],
                left_point: Column, right_point: Column, low: float, high: float,
                residual: Column, how: str = "inner") -> DataFrame:
    """Pairs with ``low <= right_point - left_point <= high`` and ``residual``.

    Left rows keep one bucket and right rows are copied into the one or two
    buckets they can meet, so semi, anti and left joins work unchanged.
    """
    width = 2 * (high - low + 1)
    lefts = left.withColumn(_BUCKET, _bucket(left_point, width))
    span = F.sequence(_bucket(right_point - F.lit(high), width),
                      _bucket(right_point - F.lit(low), width))
    rights = right.withColumn(_BUCKET + "_r", F.explode(span))
    out = join_rows(lefts, rights, [*keys, (_BUCKET, _BUCKET + "_r")], residual, how)
    return out.drop(_BUCKET, _BUCKET + "_r")


def containment_join(points: DataFrame, ranges: DataFrame, keys: Sequence[tuple[str, str]],
                     point: Column, low: Column, high: Column, residual: Column) -> DataFrame:
    """Inner pairs with ``low <= point <= high``, where low and high vary by range row.

    A range goes to the bucket level whose width matches its length and so
    covers at most two buckets however long it is.  A point takes one bucket at
    every level that occurs; the levels are one aggregated value, at most 22
    small numbers.
    """
    level = F.ceil(F.log2(F.greatest(high - low, F.lit(0)) + 1) / _LEVEL_BITS).cast("int")
    width = F.pow(F.lit(2.0), F.col(_LEVEL) * _LEVEL_BITS)
    valid = ranges.where(high >= low).withColumn(_LEVEL, level)
    levels = valid.agg(F.collect_set(_LEVEL)).scalar()
    span = F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))
    spread = valid.withColumn(_BUCKET, F.explode(span))

    probe_width = F.pow(F.lit(2.0), F.col(_LEVEL + "_p") * _LEVEL_BITS)
    probes = points.withColumn(_LEVEL + "_p", F.explode(levels)).withColumn(
        _BUCKET + "_p", F.floor(point / probe_width).cast("long"))
    extra = [(_LEVEL + "_p", _LEVEL), (_BUCKET + "_p", _BUCKET)]
    out = join_rows(probes, spread, [*keys, *extra],
                    residual & (point >= low) & (point <= high), "inner")
    return out.drop(_LEVEL, _BUCKET, _LEVEL + "_p", _BUCKET + "_p")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]],
                 left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of closed intervals that share at least one point.

    Either the right one starts inside the left one, or the left one starts
    strictly inside the right one; the two cases never coincide.
    """
    ls, le = (F.col(c) for c in left_bounds)
    rs, re = (F.col(c) for c in right_bounds)
    swapped = [(rk, lk) for lk, rk in keys]
    right_starts_inside = containment_join(right, left, swapped, rs, ls, le, F.lit(True))
    left_starts_inside = containment_join(left, right, keys, ls, rs, re, ls > rs)
    columns = [*left.columns, *right.columns]
    return right_starts_inside.select(*columns).union(left_starts_inside.select(*columns))
