"""What the operators share: typed reads, shared scratch, and digests of spans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: what the cluster names, a new one of our own only in local mode without that."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder as Parquet, so that neither lineage nor lost executors matter."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def span_list(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """(start, kind's place, end) as kind:start:end, by start and then place."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
