"""Running values over one key without sorting that key in one task.

A plain window sorts all rows of a key together.  Here the order axis is cut
into chunks: rows are scanned inside (key, chunk), one summary row per chunk is
scanned per key, and the summary is joined back.  The result equals the plain
window's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators.spread import spread

CHUNK = 1 << 16


def chunk_of(order: Column, size: int = CHUNK) -> Column:
    return F.floor(order / F.lit(size)).cast("long")


def _join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their chunk, in the place that they have.

    Keys that differ are counted, null-safe: as join keys they would place the rows anew."""
    names = ["__place", *keys, "__chunk"]
    renamed = summary.select(*[F.col(k).alias("__s_" + k) for k in names],
                             *[c for c in summary.columns if c not in names])
    differ = [(~F.col(k).eqNullSafe(F.col("__s_" + k))).cast("int") for k in names[1:]]
    condition = (F.col("__place") == F.col("__s___place")) & (reduce(add, differ) == 0)
    return rows.join(renamed, condition, "left").drop(*["__s_" + k for k in names])


def _running(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], size: int,
             over_rows, per_chunk: Column, over_chunks, last_row: int) -> DataFrame:
    """Columns ``__local`` (this chunk's rows up to ``last_row``) and ``__carry`` (earlier chunks)."""
    rows = df.withColumn("__chunk", chunk_of(F.col(order), size))
    # A number for each chunk, never null, by which its rows are placed once, in many small tasks.
    rows = spread(rows.withColumn("__place", F.xxhash64(*keys, "__chunk")), "__place")
    inside = (Window.partitionBy("__place", *keys, "__chunk").orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, last_row))
    before = (Window.partitionBy(*keys).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    summary = rows.groupBy("__place", *keys, "__chunk").agg(per_chunk.alias("__part")).withColumn(
        "__carry", over_chunks(F.col("__part")).over(before)).drop("__part")
    scanned = rows.withColumn("__local", over_rows.over(inside))
    return _join_summary(scanned, summary, keys).drop("__place", "__chunk")


def prefix_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
               size: int = CHUNK) -> DataFrame:
    """Sum of ``value`` over the key's rows with a smaller ``order``, 0 at the start.

    ``order`` must be unique within the key.
    """
    both = _running(df, keys, order, (), size, F.sum(value), F.sum(value), F.sum, -1)
    return both.withColumn(
        out, F.coalesce("__local", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    ).drop("__local", "__carry")


def prefix_max(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
               size: int = CHUNK, ties: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """Maximum of ``value`` over the key's rows before this one, by (order, ties)."""
    last = Window.currentRow if inclusive else -1
    both = _running(df, keys, order, ties, size, F.max(value), F.max(value), F.max, last)
    return both.withColumn(out, F.greatest("__local", "__carry")).drop("__local", "__carry")


def carry_last(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: str,
               out: str, size: int = CHUNK) -> DataFrame:
    """The latest non-null ``value`` at or before each row, by (order, ties)."""
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order, *ties)))
    both = _running(df, keys, order, ties, size, F.last(value, ignorenulls=True), latest,
                    lambda part: F.last(part, ignorenulls=True), Window.currentRow)
    return both.withColumn(out, F.coalesce("__local", "__carry")).drop("__local", "__carry")


def number_rows(df: DataFrame, keys: Sequence[str], group: str, within: Sequence[str], out: str,
                size: int = CHUNK) -> DataFrame:
    """1-based position within the key by (group, within).

    ``group`` (a frame) is the chunked axis; the rows sharing one group value
    are numbered together, so they should be few.
    """
    counts = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"))
    offsets = prefix_sum(counts, keys, group, "__n", "__offset", size).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys, group).orderBy(*within))
    return df.withColumn("__rn", local).join(offsets, [*keys, group]).withColumn(
        out, (F.col("__rn") + F.col("__offset")).cast("long")).drop("__rn", "__offset")
