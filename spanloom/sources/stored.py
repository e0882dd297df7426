"""Changing a stored table in place, bucket by bucket.

Tables written by ``write_table`` hash recordings into folders.  A change names recordings,
so only their buckets are read and written again, by Spark's dynamic partition overwrite;
the files of all other buckets stay as they are.  The rows of a rewritten bucket are staged
beside the table and moved in when all tasks have ended, so a lost executor costs only its
own tasks; two jobs must not change one table at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.sources.tables import upsert_latest, with_bucket

BUCKET = "analysis_bucket"


def stored(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def touched(changes: DataFrame, table: DataFrame, buckets: int) -> list[int]:
    """The buckets of the changed recordings, at most ``buckets`` numbers."""
    # The hash depends on the type, so ids take the table's.
    ids = changes.select(F.col("analysis_id").cast(table.schema["analysis_id"].dataType).alias("analysis_id"))
    return sorted(r[BUCKET] for r in with_bucket(ids.distinct(), buckets).select(BUCKET).distinct().collect())


def rewrite(table: DataFrame, rows: DataFrame, path: str, among: Sequence[int], fmt: str = "parquet") -> None:
    """``rows`` in place of the buckets ``among``; one that no row is left for loses its folder."""
    from spanloom.session import scratch_dir

    spark = table.sparkSession
    staged = scratch_dir(spark, "rewritten")
    inner = [c for c in ("analysis_id", "frame", "start_frame") if c in rows.columns]
    rows.select(*table.columns).hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *inner).write.partitionBy(
        BUCKET).format(fmt).save(staged)
    new = spark.read.format(fmt).schema(table.schema).load(staged)
    left = {r[BUCKET] for r in new.select(BUCKET).distinct().collect()}
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).format(fmt).save(path)
    for bucket in set(among) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{BUCKET}={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], version: str, *, buckets: int = 64,
           fmt: str = "parquet") -> list[int]:
    """Merge rows into the stored table, the highest version of a key wins; the buckets written are returned.

    ``keys`` hold the recording, so all rows of a key are in one bucket.
    """
    if "analysis_id" not in keys:
        raise ValueError("the keys of a stored table hold analysis_id")
    table = stored(spark, path, fmt=fmt)
    kind = table.schema["analysis_id"].dataType
    among = touched(new, table, buckets)
    if among:
        come = with_bucket(new.withColumn("analysis_id", F.col("analysis_id").cast(kind)), buckets)
        old = table.where(F.col(BUCKET).isin(among))
        rewrite(table, upsert_latest(old, come, [BUCKET, *keys], version), path, among, fmt)
    return among


def delete(spark: SparkSession, paths: Sequence[str], doomed: DataFrame, *, buckets: int = 64, fmt: str = "parquet") -> list[int]:
    """Remove recordings from stored tables that share the layout, as intervals and their participants do."""
    among: list[int] = []
    for path in paths:
        table = stored(spark, path, fmt=fmt)
        kind = table.schema["analysis_id"].dataType
        among = touched(doomed, table, buckets)
        if among:
            gone = doomed.select(F.col("analysis_id").cast(kind).alias("analysis_id")).distinct()
            rewrite(table, table.where(F.col(BUCKET).isin(among)).join(gone, "analysis_id", "left_anti"), path, among, fmt)
    return among
