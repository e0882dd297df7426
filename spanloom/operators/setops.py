"""Set operations on detections with aligned column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def padded(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both operands with the union of their columns, NULL where one has none."""
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]

    def widen(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.select(*[
            F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c)
            for c in names])

    return widen(left, right), widen(right, left)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = padded(left, right)
    return a.subtract(b)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = padded(left, right)
    return a.intersect(b)


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both operands with their columns matched by position and the shorter one padded with NULL.

    Names are the left's, then the right's own; one that the left has already gets a number.
    """
    names = list(left.columns)
    for c in right.columns[len(names):]:
        names.append(c if c not in names else f"{c}_{len(names) + 1}")

    def widen(df: DataFrame, other: DataFrame) -> DataFrame:
        missing = other.schema.fields[len(df.columns):]
        return df.select("*", *[F.lit(None).cast(f.dataType).alias(f"__p{k}") for k, f in enumerate(missing)]).toDF(*names)

    return widen(left, right), widen(right, left)


def positional_union(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.union(b).distinct()


def positional_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.subtract(b)


def positional_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = aligned(left, right)
    return a.intersect(b)


def multimodal_union(visual: DataFrame, audio: DataFrame) -> DataFrame:
    """Union that records which modality each detection came from."""
    return union(visual.withColumn("modality", F.lit("visual")),
                 audio.withColumn("modality", F.lit("audio")))
