"""Unbounded Bef in slices of a bounded number of rows.

All pairs of one (recording, object) are wanted, so their number is what it is; but no
task should hold a hot object's rows whole.  The first intervals are cut along their
ends and the second along their starts into slices of ``rows`` each; a slice of firsts
meets only those slices of seconds that reach past its earliest end.  Each such tile is
one group of the join, with at most ``rows`` rows on either side, and the tiles that
exist are known from one small row a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanloom.operators.prefix import number_rows

SLICE_ROWS = 1 << 14


def sliced(df: DataFrame, keys: Sequence[str], order: str, rows: int, out: str) -> DataFrame:
    """``out``: number of the row's slice in its key along ``order``; slices hold ``rows`` rows, the last one the rest."""
    rest = [f.name for f in df.schema if f.name not in keys and f.name != order and not isinstance(f.dataType, T.MapType)]
    numbered = number_rows(df, keys, order, rest or [order], "__n")
    return numbered.withColumn(out, F.floor((F.col("__n") - 1) / F.lit(rows)).cast("long")).drop("__n")


def before_in_tiles(first: DataFrame, second: DataFrame, on: Sequence[tuple[str, str]], end: str, start: str,
                    slack: int | float | Column, match: Column, rows: int = SLICE_ROWS) -> DataFrame:
    """Inner join of pairs that satisfy ``match``, which implies equal keys and ``end <= start + slack``.

    Rows with a null key, end or start have no partner.  Copies stay copies.
    """
    if rows < 1:
        raise ValueError("a slice needs at least one row")
    left_keys, right_keys = [l for l, _ in on], [r for _, r in on]
    left = sliced(first.where(F.col(end).isNotNull()), left_keys, end, rows, "__i")
    right = sliced(second.where(F.col(start).isNotNull()), right_keys, start, rows, "__j")
    earliest = left.groupBy(*left_keys, "__i").agg(F.min(end).alias("__from"))
    latest = right.groupBy(*right_keys, "__j").agg(F.max(start).alias("__to"))
    meets = F.col("__from") <= F.col("__to") + slack
    for l, r in on:
        meets = meets & (F.col(l) == F.col(r))
    tiles = earliest.join(latest, meets)
    to_left = tiles.select(*[F.col(l).alias(f"__t_{l}") for l in left_keys], F.col("__i").alias("__ti"), F.col("__j").alias("__tj"))
    to_right = tiles.select(*[F.col(r).alias(f"__u_{r}") for r in right_keys], F.col("__i").alias("__ui"), F.col("__j").alias("__uj"))
    here, there = F.col("__i") == F.col("__ti"), F.col("__j") == F.col("__uj")
    for l, r in on:
        here, there = here & (F.col(l) == F.col(f"__t_{l}")), there & (F.col(r) == F.col(f"__u_{r}"))
    firsts = left.join(to_left, here).select(*first.columns, "__ti", "__tj")
    seconds = right.join(to_right, there).select(*second.columns, "__ui", "__uj")
    together = match & (F.col("__ti") == F.col("__ui")) & (F.col("__tj") == F.col("__uj"))
    for l, r in on:
        together = together & (F.col(l) == F.col(r))
    return firsts.join(seconds, together).select(*first.columns, *second.columns)
