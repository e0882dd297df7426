"""Label text: cleaning, stemming, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanloom.vocab import LABEL_DROPPED, LABEL_EDGE, STEM_SUFFIXES, TOKEN_BREAKS, TOKEN_EDGE


def clean_label(text: Column) -> Column:
    """Keep letters, digits, ``_`` and blanks; lower-case; join words with ``_``."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), LABEL_DROPPED, " "))
    return F.replace(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(" "), F.lit("_"))


def canonical_class(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))


def stem(word: Column) -> Column:
    """Drop a suffix when at least three letters stay before it.

    The suffixes are tried in order; a plain ``s`` precedes every other one that
    ends in s, so the shortest match, which the greedy prefix takes, is the first.
    """
    base = F.btrim(F.lower(word), F.lit(LABEL_EDGE))
    return F.regexp_replace(base, "(?s)^(.{3,})(?:" + "|".join(STEM_SUFFIXES) + ")$", "$1")


def label_tokens(cleaned: Column) -> Column:
    """Words of at least two characters from a cleaned label."""
    parts = F.split(cleaned, TOKEN_BREAKS)
    trimmed = F.transform(parts, lambda t: F.btrim(t, F.lit(TOKEN_EDGE)))
    return F.filter(trimmed, lambda t: F.length(t) >= 2)


def object_document(class_id: Column, cls: Column, description: Column, blocks: Column,
                    frame: Column) -> Column:
    """One searchable line per remembered object."""
    block_text = F.concat(F.lit("["), F.array_join(blocks.cast("array<string>"), ", "), F.lit("]"))
    return F.concat(
        F.lit("ID "), class_id.cast("string"), F.lit(", Class "), cls, F.lit(", "), description,
        F.lit(", Blocks "), block_text, F.lit(", Frame "), frame.cast("string"),
    )


def block_box(blocks: Column, rows: int, cols: int, width: Column, height: Column) -> Column:
    """Pixel rectangle covering the grid blocks; the whole frame when empty."""
    bw = F.floor(width / max(cols, 1)).cast("int")
    bh = F.floor(height / max(rows, 1)).cast("int")
    left = F.transform(blocks, lambda b: F.pmod(b - 1, F.lit(cols)) * bw)
    top = F.transform(blocks, lambda b: F.floor((b - 1) / cols).cast("int") * bh)
    x1, y1 = F.array_min(left), F.array_min(top)
    x2 = F.least(F.array_max(left) + bw, width)
    y2 = F.least(F.array_max(top) + bh, height)
    full = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), width.alias("x2"), height.alias("y2"))
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), box).otherwise(full)
