"""Tasks of bounded memory behind a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread(rows: DataFrame, *by: str | Column) -> DataFrame:
    """The rows by a hash of ``by`` in as many partitions as ``spark.sql.shuffle.partitions`` says.

    Left to itself, adaptive execution joins partitions until there are as few as cores, or
    64 MB each, which in a task that sorts and aggregates them grow to a gigabyte and more.
    Steps that hold several copies of their rows ask for all partitions instead.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by)
