"""Event chains: consecutive intervals tied together by temporal operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.select import Selection
from spanloom.operators.temporal import Temporal, temporal_join

_OPERATIONS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def flat(ref: str) -> str:
    """``M1.arg1`` names the column ``M1_arg1`` of a chain."""
    return ref.replace(".", "_", 1)


@dataclass(frozen=True)
class Condition:
    """``left op right`` between columns of the chain, or against a number."""

    left: str
    op: str
    right: str | int | float

    def __post_init__(self) -> None:
        if self.op not in _OPERATIONS:
            raise ValueError(f"unknown comparison {self.op!r}")

    @property
    def aliases(self) -> set[str]:
        sides = [self.left] + ([self.right] if isinstance(self.right, str) else [])
        return {s.split(".", 1)[0] for s in sides}

    def column(self) -> Column:
        right = F.col(flat(self.right)) if isinstance(self.right, str) else F.lit(self.right)
        return _OPERATIONS[self.op](F.col(flat(self.left)), right)


@dataclass(frozen=True)
class Duration:
    """``(end of one interval - start of another) op value``, in the chain's own unit."""

    end_of: str
    start_of: str
    op: str
    value: int | float
    bounds: tuple[str, str] = ("sf", "ef")

    def __post_init__(self) -> None:
        if self.op not in _OPERATIONS:
            raise ValueError(f"unknown comparison {self.op!r}")
        if self.value in (float("inf"), float("-inf")):
            raise ValueError("a duration bound must be finite")

    @property
    def aliases(self) -> set[str]:
        return {self.end_of, self.start_of}

    def column(self) -> Column:
        start, end = self.bounds
        length = F.col(f"{self.end_of}_{end}") - F.col(f"{self.start_of}_{start}")
        return _OPERATIONS[self.op](length, F.lit(self.value))


def aliased(intervals: DataFrame, alias: str, key: str = "analysis_id") -> DataFrame:
    return intervals.selectExpr(key, *[
        f"`{c}` AS `{alias}_{c}`" for c in intervals.columns if c != key])


def chain(intervals: Sequence[DataFrame], operators: Sequence[Temporal],
          conditions: Sequence[Condition | Duration] = (), *,
          bounds: tuple[str, str] = ("sf", "ef"), strategy: str = "auto",
          salt: int = 1, slice_rows: int | None = None) -> DataFrame:
    """M1 op M2 op M3 ... as left-deep joins, with bag semantics.

    Interval i appears as columns ``M{i}_*``.  Each condition is applied at the
    first join that sees all its intervals; an equality between the new interval
    and an earlier one becomes part of that join's key.
    """
    if len(operators) != len(intervals) - 1:
        raise ValueError("a chain of n intervals needs n - 1 operators")
    start, end = bounds
    out = aliased(intervals[0], "M1")
    seen, pending = {"M1"}, list(conditions)
    ready = [c for c in pending if c.aliases <= seen]
    for c in ready:
        out = out.where(c.column())
    pending = [c for c in pending if c not in ready]
    for i, spec in enumerate(operators, start=2):
        new, previous = f"M{i}", f"M{i - 1}"
        right = aliased(intervals[i - 1], new).withColumnRenamed("analysis_id", "__right_id")
        seen.add(new)
        ready = [c for c in pending if c.aliases <= seen]
        pending = [c for c in pending if c not in ready]
        local = [c for c in ready if c.aliases == {new}]
        for c in local:
            right = right.where(c.column())
        keys = [("analysis_id", "__right_id")]
        residual = None
        for c in ready:
            if c in local:
                continue
            pair = _equality(c, new)
            if pair:
                keys.append(pair)
            else:
                residual = c.column() if residual is None else residual & c.column()
        out = temporal_join(
            out, right, spec, on=keys, where=residual, strategy=strategy, salt=salt, slice_rows=slice_rows,
            left_bounds=(f"{previous}_{start}", f"{previous}_{end}"),
            right_bounds=(f"{new}_{start}", f"{new}_{end}"),
        ).drop("__right_id")
    if pending:
        raise ValueError(f"conditions name unknown intervals: {pending}")
    return out


def _equality(condition: Condition | Duration, new: str) -> tuple[str, str] | None:
    if not isinstance(condition, Condition) or condition.op != "=":
        return None
    if not isinstance(condition.right, str):
        return None
    sides = [condition.left, condition.right]
    if sides[0].split(".", 1)[0] == new:
        sides.reverse()
    if sides[1].split(".", 1)[0] != new or sides[0].split(".", 1)[0] == new:
        return None
    return flat(sides[0]), flat(sides[1])


def as_interval(sub_chain: DataFrame, size: int, bounds: tuple[str, str] = ("sf", "ef")) -> DataFrame:
    """A chain as one interval: its span, with all its columns kept.

    The result can be an element of an outer chain, where ``M1_arg1`` becomes
    ``M2_M1_arg1``.
    """
    start, end = bounds
    starts = [F.col(f"M{i}_{start}") for i in range(1, size + 1)]
    ends = [F.col(f"M{i}_{end}") for i in range(1, size + 1)]
    low = F.least(*starts) if size > 1 else starts[0]
    high = F.greatest(*ends) if size > 1 else ends[0]
    return sub_chain.withColumn(start, low).withColumn(end, high)


def project(rows: DataFrame, *refs: str) -> DataFrame:
    """Explicit projection list, e.g. ``"M1.arg1", "M2.ef"``."""
    return rows.select("analysis_id", *[F.col(flat(r)) for r in refs])


def default_projection(rows: DataFrame, size: int, bounds: tuple[str, str] = ("sf", "ef")) -> DataFrame:
    """First start to last end, then every interval's arguments and bounds."""
    start, end = bounds
    own = [c for i in range(1, size + 1) for c in rows.columns
           if c.startswith(f"M{i}_arg") or c in (f"M{i}_{start}", f"M{i}_{end}")]
    return rows.select(
        "analysis_id", F.col(f"M1_{start}").alias("start_frame"),
        F.col(f"M{size}_{end}").alias("end_frame"), *own)


def class_labels(refs: Sequence[str], selections: Sequence[Selection]) -> list[str]:
    """Output names: ``M1_sf`` for bounds; participants by class, numbered from the second of a class in an interval."""
    parts = [ref.split(".", 1) for ref in refs]
    slots = [(place, interval, selections[int(interval[1:]) - 1].slot_class(int(attribute[3:])))
             for place, (interval, attribute) in enumerate(parts) if attribute.startswith("arg")]
    names = {place: f"{interval}_{attribute}" for place, (interval, attribute) in enumerate(parts)}
    for group in {slot[1:] for slot in slots}:
        members = [slot[0] for slot in slots if slot[1:] == group]
        names |= {place: "_".join(group) + (str(number) if number > 1 else "")
                  for number, place in enumerate(members, 1)}
    return [names[place] for place in range(len(parts))]
