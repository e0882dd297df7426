"""The eight parametrised temporal joins.

Left rows are r, right rows are s.  ``delta`` and ``epsilon`` bound the distance
of starts, ends or the gap (None = unbounded); ``zeta`` and ``eta`` are the
strictness of the opening and closing comparison; ``rho`` is a tolerance that
loosens every bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.range_join import (
    banded_join, containment_join, join_rows, salted_join,
)
from spanloom.operators.sliced import before_in_tiles
from spanloom.vocab import STRICTNESS

OPERATORS = ("Bef", "Aft", "SP", "EF", "DJ", "RDJ", "LOJ", "ROJ")
# Each reverse operator is its partner with r and s exchanged.
_REVERSED = {"Aft": "Bef", "RDJ": "DJ", "ROJ": "LOJ"}
_BOUNDED_BELOW = ("<=", "<")
# Further than any two points lie apart.
FAR = float(1 << 52)

Threshold = int | float | Column | None


def compare(left: Column, op: str | Column, right: Column) -> Column:
    """``left op right``; the operator may itself be a column of symbols."""
    if isinstance(op, Column):
        return (F.when(op == "<", left < right).when(op == ">", left > right)
                .when(op == ">=", left >= right).otherwise(left <= right))
    if op not in STRICTNESS:
        raise ValueError(f"strictness must be one of {STRICTNESS}, got {op!r}")
    return {"<=": left <= right, "<": left < right, ">=": left >= right, ">": left > right}[op]


@dataclass(frozen=True)
class Temporal:
    """One temporal operator with its parameters.

    A parameter may be a Column of the joined rows, which lets one job evaluate
    a table of thresholds.  Where all of them are columns of one side, each of its rows gets
    buckets of its own reach.  ``bucket_delta`` is for other cases a number that most deltas
    do not exceed; it only sizes the buckets and never decides a match.
    """

    op: str
    delta: Threshold = None
    epsilon: Threshold = None
    zeta: str | Column = "<="
    eta: str | Column = "<="
    rho: int | float | Column = 0
    bucket_delta: int | float | None = None
    # Set by the join for rows whose threshold is known to lie within it.
    banded_delta: int | float | None = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown temporal operator {self.op!r}")
        for symbol in (self.zeta, self.eta):
            if not isinstance(symbol, Column) and symbol not in STRICTNESS:
                raise ValueError(f"strictness must be one of {STRICTNESS}, got {symbol!r}")
        if not isinstance(self.rho, Column) and self.rho < 0:
            raise ValueError("rho must not be negative")

    @property
    def reversed(self) -> bool:
        return self.op in _REVERSED

    @property
    def sliceable(self) -> bool:
        """Whether every match ends before it starts, but for a tolerance that is one number."""
        fixed = not isinstance(self.zeta, Column) and not isinstance(self.rho, Column)
        return fixed and self.op in ("Bef", "Aft") and self.zeta in _BOUNDED_BELOW

    def forward(self) -> Temporal:
        return replace(self, op=_REVERSED.get(self.op, self.op))

    def _within(self, distance: Column, limit: Threshold) -> Column:
        if limit is None:
            return F.lit(True)
        if isinstance(limit, Column):
            return F.coalesce(distance <= limit + self.rho, F.lit(True))
        return distance <= F.lit(limit) + self.rho

    def predicate(self, r_start: Column, r_end: Column, s_start: Column, s_end: Column) -> Column:
        """The exact match condition."""
        if self.reversed:
            return self.forward().predicate(s_start, s_end, r_start, r_end)
        rho = self.rho
        if self.op == "Bef":
            return (compare(r_end, self.zeta, s_start + rho)
                    & self._within(s_start - r_end, self.delta))
        if self.op == "SP":
            return (compare(r_start - rho, self.zeta, s_start) & (s_start < r_end + rho)
                    & self._within(s_start - r_start, self.delta))
        if self.op == "EF":
            return ((r_start - rho < s_end) & compare(s_end, self.eta, r_end + rho)
                    & self._within(r_end - s_end, self.epsilon))
        if self.op == "DJ":
            return (compare(s_start - rho, self.zeta, r_start) & (r_start <= s_end + rho)
                    & (s_start - rho <= r_end) & compare(r_end, self.eta, s_end + rho)
                    & self._within(r_start - s_start, self.delta)
                    & self._within(s_end - r_end, self.epsilon))
        return (compare(r_start - rho, self.zeta, s_start) & (s_start < r_end + rho)
                & (s_start - rho < r_end) & compare(r_end, self.eta, s_end + rho)
                & self._within(s_start - r_start, self.delta)
                & self._within(s_end - r_end, self.epsilon))

    def own_reach(self, length: Column | None) -> tuple[str, str, Column, Column]:
        """(r point, s point, low, high): how far s's point may lie behind r's, by this row's own parameters.

        Described for the forward operator.  ``length`` is that of the row that holds the
        parameters, if the operator puts the other row's point into it.
        """
        def limit(value: Threshold) -> Column:
            given = F.lit(FAR) if value is None else F.coalesce(
                value if isinstance(value, Column) else F.lit(value), F.lit(FAR))
            return F.least(given if length is None else F.least(given, length), F.lit(FAR)) + self.rho

        def unless_reversed(symbol: str | Column, bound: Column, open_: float) -> Column:
            if isinstance(symbol, Column):
                return F.when(symbol.isin(*_BOUNDED_BELOW), bound).otherwise(F.lit(open_))
            return bound if symbol in _BOUNDED_BELOW else F.lit(open_)

        rho = self.rho if isinstance(self.rho, Column) else F.lit(self.rho)
        if self.op in ("Bef", "SP", "LOJ"):
            return "end" if self.op == "Bef" else "start", "start", unless_reversed(self.zeta, -rho, -FAR), limit(self.delta)
        if self.op == "DJ":
            return "start", "start", -limit(self.delta), unless_reversed(self.zeta, rho, FAR)
        return "end", "end", -limit(self.epsilon), unless_reversed(self.eta, rho, FAR)

    def band(self) -> tuple[str, str, float, float] | None:
        """(r point, s point, low, high) when two points lie within a fixed distance.

        Described for the forward operator; None if the parameters leave it open.
        """
        if isinstance(self.rho, Column):
            return None
        opening = self.zeta in _BOUNDED_BELOW if isinstance(self.zeta, str) else False
        closing = self.eta in _BOUNDED_BELOW if isinstance(self.eta, str) else False
        bound = self.bucket_delta if self.banded_delta is None else self.banded_delta
        delta = bound if isinstance(self.delta, Column) else self.delta
        epsilon = None if isinstance(self.epsilon, Column) else self.epsilon
        rho = self.rho
        name = self.forward().op
        if name == "Bef" and opening and delta is not None:
            return "end", "start", -rho, delta + rho
        if name in ("SP", "LOJ") and opening and delta is not None:
            return "start", "start", -rho, delta + rho
        if name == "DJ" and opening and delta is not None:
            return "start", "start", -delta - rho, rho
        if name == "EF" and closing and epsilon is not None:
            return "end", "end", -epsilon - rho, rho
        if name in ("DJ", "LOJ") and closing and epsilon is not None:
            return "end", "end", -rho, epsilon + rho
        return None

    def containment(self) -> tuple[str, str] | None:
        """(range row, point of the other row) when one row's point lies in the other row."""
        if isinstance(self.rho, Column):
            return None
        opening = self.zeta in _BOUNDED_BELOW if isinstance(self.zeta, str) else False
        closing = self.eta in _BOUNDED_BELOW if isinstance(self.eta, str) else False
        name = self.forward().op
        if name in ("SP", "LOJ") and opening:
            return "r", "start"
        if name == "EF" and closing:
            return "r", "end"
        if name == "DJ" and opening:
            return "s", "start"
        if name == "DJ" and closing:
            return "s", "end"
        return None


def temporal_join(left: DataFrame, right: DataFrame, spec: Temporal, *,
                  on: Sequence[tuple[str, str]],
                  left_bounds: tuple[str, str], right_bounds: tuple[str, str],
                  where: Column | None = None, how: str = "inner",
                  strategy: str = "auto", salt: int = 1, slice_rows: int | None = None) -> DataFrame:
    """Join two interval tables whose column names do not clash.

    ``on`` holds the equality pairs, the recording among them.  ``strategy``:

    * ``auto`` buckets by time wherever the parameters bound a distance, so one
      long recording spreads over many tasks;
    * ``recording`` joins on the equality pairs alone, which saves the copies
      when every recording is known to be short.

    A pair's bound is open only for an unbounded Bef/Aft or a reversed
    strictness.  Those join on the equality pairs: AQE splits a hot key, and
    ``salt`` > 1 spreads every key over that many tasks beforehand, and ``slice_rows``
    cuts an inner unbounded Bef/Aft into tiles of at most so many rows a side.
    """
    if strategy not in ("auto", "recording"):
        raise ValueError(f"unknown strategy {strategy!r}")
    bounds = {"r": left_bounds, "s": right_bounds}
    rs, re = (F.col(c) for c in left_bounds)
    ss, se = (F.col(c) for c in right_bounds)
    match = spec.predicate(rs, re, ss, se)
    if where is not None:
        match = match & where

    def point(side: str, which: str) -> Column:
        return F.col(bounds[side][0 if which == "start" else 1])

    own = [c for c in (spec.delta, spec.epsilon, spec.rho, spec.zeta, spec.eta) if isinstance(c, Column)]
    if own and how == "inner" and strategy == "auto" and spec.banded_delta is None:
        holder = "r" if _holds(left, own) else "s" if _holds(right, own) else None
        if holder:
            return _by_own_reach(left, right, spec, holder, on, bounds, match)
    band = spec.band() if strategy == "auto" else None
    if band and isinstance(spec.delta, Column) and "start" in band[:2] and spec.bucket_delta is not None:
        return _by_bound(left, right, spec, how, {
            "on": on, "left_bounds": left_bounds, "right_bounds": right_bounds, "where": where, "salt": salt})
    if band:
        r_which, s_which, low, high = band
        if spec.reversed:
            # The forward r is this join's s: mirror the band.
            return banded_join(left, right, on, point("r", s_which), point("s", r_which),
                               -high, -low, match, how)
        return banded_join(left, right, on, point("r", r_which), point("s", s_which),
                           low, high, match, how)

    inside = spec.containment() if strategy == "auto" and how == "inner" else None
    if inside:
        holder, which = inside
        if spec.reversed:
            holder = "s" if holder == "r" else "r"
        other = "s" if holder == "r" else "r"
        tables = {"r": left, "s": right}
        keys = list(on) if other == "r" else [(rk, lk) for lk, rk in on]
        low, high = (F.col(c) for c in bounds[holder])
        out = containment_join(tables[other], tables[holder], keys, point(other, which),
                               low - spec.rho, high + spec.rho, match)
        return out.select(*left.columns, *right.columns)

    if slice_rows and how == "inner" and spec.sliceable:
        if spec.reversed:
            out = before_in_tiles(right, left, [(r, l) for l, r in on], right_bounds[1], left_bounds[0], spec.rho, match, slice_rows)
            return out.select(*left.columns, *right.columns)
        return before_in_tiles(left, right, on, left_bounds[1], right_bounds[0], spec.rho, match, slice_rows)
    if salt > 1 and how == "inner":
        return salted_join(left, right, on, match, salt)
    return join_rows(left, right, on, match, how)


def _holds(df: DataFrame, columns: Sequence[Column]) -> bool:
    try:
        df.select(*columns).schema
    except AnalysisException:
        return False
    return True


def _by_own_reach(left: DataFrame, right: DataFrame, spec: Temporal, holder: str, on: Sequence[tuple[str, str]],
                  bounds: dict[str, tuple[str, str]], match: Column) -> DataFrame:
    """Parameters are columns of one side: its rows are ranges of where the other's point may lie, each on the
    bucket level of its own length, so short and far ones, and a tolerance a row, share one join."""
    first = holder == ("s" if spec.reversed else "r")  # the holder is the forward operator's r
    begin, end = (F.col(c) for c in bounds[holder])
    inside = spec.forward().op in (("SP", "LOJ", "EF") if first else ("DJ",))
    r_which, s_which, low, high = spec.forward().own_reach(end - begin if inside else None)
    mine, its = (r_which, s_which) if first else (s_which, r_which)
    here = begin if mine == "start" else end
    other = "s" if holder == "r" else "r"
    point = F.col(bounds[other][0 if its == "start" else 1])
    tables = {"r": left, "s": right}
    keys = list(on) if other == "r" else [(rk, lk) for lk, rk in on]
    span = (here + low, here + high) if first else (here - high, here - low)
    return containment_join(tables[other], tables[holder], keys, point, *span, match).select(*left.columns, *right.columns)


def either_join(left: DataFrame, right: DataFrame, symbol: Column, one: Temporal, other: Temporal, *,
                on: Sequence[tuple[str, str]], left_bounds: tuple[str, str], right_bounds: tuple[str, str],
                where: Column) -> DataFrame:
    """Pairs by the operator that each left row names, of two that bound the right row's start; one join for both.

    The parameters are columns of the left rows.
    """
    begin, end = (F.col(c) for c in left_bounds)
    start, stop = (F.col(c) for c in right_bounds)
    spans, matches = [], []
    for spec in (one, other):
        mine, its, low, high = spec.own_reach(end - begin if spec.op in ("SP", "LOJ") else None)
        if spec.reversed or its != "start":
            raise ValueError(f"{spec.op} does not bound the start of the right row")
        here = begin if mine == "start" else end
        spans.append((here + low, here + high))
        matches.append(spec.predicate(begin, end, start, stop))
    is_one = symbol == one.op
    low, high = (F.when(is_one, a).otherwise(b) for a, b in zip(*spans))
    match = F.when(is_one, matches[0]).otherwise(matches[1]) & where
    return containment_join(right, left, [(rk, lk) for lk, rk in on], start, low, high, match).select(*left.columns, *right.columns)


def _by_bound(left: DataFrame, right: DataFrame, spec: Temporal, how: str, rest: dict) -> DataFrame:
    """A threshold that is a column: rows within ``bucket_delta`` join by buckets, the others (unbounded, or
    further than that) on the equalities, so the bound decides no match."""
    near = F.coalesce(spec.delta <= F.lit(spec.bucket_delta), F.lit(False))
    bounded = replace(spec, delta=F.least(spec.delta, F.lit(spec.bucket_delta)), bucket_delta=None)
    if _holds(left, [spec.delta]):
        parts = [(left.where(near), right), (left.where(~near), right)]
    elif how == "inner" and _holds(right, [spec.delta]):
        parts = [(left, right.where(near)), (left, right.where(~near))]
    else:
        return temporal_join(left, right, spec, how=how, strategy="recording", **rest)
    close = temporal_join(*parts[0], replace(bounded, banded_delta=spec.bucket_delta), how=how, **rest)
    return close.unionByName(temporal_join(*parts[1], spec, how=how, strategy="recording", **rest))


def before_exists(left: DataFrame, right: DataFrame, *, on: Sequence[tuple[str, str]],
                  left_end: str, right_start: str, rho: int | float = 0,
                  strict: bool = False) -> DataFrame:
    """Left rows that some right row follows at any distance.

    An unbounded Bef has quadratically many pairs; whether one exists only
    needs the latest start per group, which aggregates before the shuffle.
    """
    keys = [rk for _, rk in on]
    latest = right.groupBy(*[F.col(k).alias("__k_" + k) for k in keys]).agg(
        F.max(right_start).alias("__latest"))
    limit = F.col("__latest") + rho
    match = F.col(left_end) < limit if strict else F.col(left_end) <= limit
    return join_rows(left, latest, [(lk, "__k_" + rk) for lk, rk in on], match, "left_semi")


def first_after(left: DataFrame, right: DataFrame, *, on: Sequence[tuple[str, str]],
                left_end: str, right_start: str, payload: str) -> DataFrame:
    """Left rows with the earliest right row that follows them, at any distance.

    Adds ``payload`` and ``right_start`` of that row (the smallest payload among
    equal starts), NULL where none follows.  Ends and starts are put on one time
    line per group and scanned once, latest first, instead of pairing every left
    row with all later right rows; copies fold before the scan.
    """
    from spanloom.operators.prefix import carry_last

    names = [f"__g{i}" for i in range(len(on))]
    ends = left.select(*[F.col(lk).alias(n) for (lk, _), n in zip(on, names)],
                       F.col(left_end).alias("__t")).distinct()
    starts = right.groupBy(*[F.col(rk).alias(n) for (_, rk), n in zip(on, names)],
                           F.col(right_start).alias("__t")).agg(F.min(payload).alias("__p"))
    hit = F.struct("__p", "__t")
    line = starts.select(*names, (-F.col("__t")).alias("__pos"), F.lit(0).alias("__side"),
                         hit.alias("__hit"))
    line = line.union(ends.select(*names, (-F.col("__t")).alias("__pos"), F.lit(1).alias("__side"),
                                  F.lit(None).cast(line.schema["__hit"].dataType).alias("__hit")))
    found = carry_last(line, names, "__pos", ["__side"], "__hit", "__next").where("__side = 1").select(
        *names, (-F.col("__pos")).alias("__t"), F.col("__next.__p").alias(payload),
        F.col("__next.__t").alias(right_start))
    same = F.col(left_end) == F.col("__t")
    for (lk, _), n in zip(on, names):
        same = same & (F.col(lk) == F.col(n))
    return left.join(found, same, "left").select(*left.columns, payload, right_start)


def classify_pair(r_start: Column, r_end: Column, s_start: Column, s_end: Column) -> Column:
    """The most specific operator for a pair, with the distances it needs."""

    def found(op: str, delta: Column | None = None, epsilon: Column | None = None) -> Column:
        empty = F.lit(None).cast("long")
        return F.struct(F.lit(op).alias("operator"),
                        (empty if delta is None else delta.cast("long")).alias("delta"),
                        (empty if epsilon is None else epsilon.cast("long")).alias("epsilon"))

    return (
        F.when(r_end <= s_start, found("Bef", s_start - r_end))
        .when(s_end <= r_start, found("Aft", r_start - s_end))
        .when((s_start <= r_start) & (r_end <= s_end),
              found("DJ", r_start - s_start, s_end - r_end))
        .when((r_start <= s_start) & (s_end <= r_end),
              found("RDJ", s_start - r_start, r_end - s_end))
        .when((r_start <= s_start) & (s_start < r_end) & (r_end <= s_end),
              found("LOJ", s_start - r_start, s_end - r_end))
        .when((s_start <= r_start) & (r_start < s_end) & (s_end <= r_end),
              found("ROJ", r_start - s_start, r_end - s_end))
        .otherwise(found("UNKNOWN"))
    )


def start_offset(r_start: Column, s_start: Column) -> Column:
    """Distance an SP needs for a pair that was forced to SP."""
    return F.greatest(s_start - r_start, F.lit(0))


def end_offset(r_end: Column, s_end: Column) -> Column:
    """Distance an EF needs for a pair that was forced to EF."""
    return F.greatest(r_end - s_end, F.lit(0))
