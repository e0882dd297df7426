"""Frame and clock arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def frames_to_seconds(frame: Column, fps: Column) -> Column:
    return frame.cast("double") / F.greatest(fps, F.lit(1))


def seconds_to_frames(seconds: Column, fps: Column) -> Column:
    """Half-even rounding, so 2.5 frames become 2."""
    return F.bround(seconds * fps).cast("long")


def truncate_frames(value: Column) -> Column:
    return value.cast("long")


def clock_text(seconds: Column) -> Column:
    """``M:SS.ss``, or ``H:MM:SS.ss`` from one hour on."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds - hours * 3600) / 60)
    rest = seconds - F.floor(seconds / 60) * 60
    return F.when(
        hours > 0, F.format_string("%d:%02d:%05.2f", hours, minutes, rest)
    ).otherwise(F.format_string("%d:%05.2f", minutes, rest))


def interval_length(start: Column, end: Column) -> Column:
    return end - start


def interval_size(start: Column, end: Column) -> Column:
    return end - start + 1


def overlap_length(r_start: Column, r_end: Column, s_start: Column, s_end: Column) -> Column:
    return F.least(r_end, s_end) - F.greatest(r_start, s_start)


def frame_rate(*rates: Column, default: int = 24) -> Column:
    """First positive integer quotient of the ``num/den`` texts, else ``default``."""

    def quotient(rate: Column) -> Column:
        parts = F.split(rate, "/")
        num = F.try_element_at(parts, F.lit(1)).try_cast("long")
        den = F.try_element_at(parts, F.lit(2)).try_cast("long")
        value = F.floor(num / F.nullif(den, F.lit(0))).cast("int")
        return F.when(value > 0, value)

    return F.coalesce(*[quotient(r) for r in rates], F.lit(default))


def unbounded(text: Column) -> Column:
    """Threshold text to a number; the infinity tokens become NULL, anything else that is no whole number fails."""
    number = F.trim(text).try_cast("int")
    return F.when(~F.trim(text).isin("inf", "∞"), F.coalesce(number, F.raise_error(
        F.concat(F.lit("not a whole number: "), text)).cast("int")))
