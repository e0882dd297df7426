"""Stored tables: typed reads, appends, upserts, deletes, exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanloom.functions.text import canonical_class
from spanloom.schema import TABLES

# Buckets that ids are numbered in; their sizes pass through one task.
ID_BUCKETS = 1 << 16


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A stored table under its declared schema; nothing is inferred."""
    return spark.read.format(fmt).schema(TABLES[name]).load(path)


def write_table(df: DataFrame, path: str, mode: str = "append",
                partition_by: Sequence[str] = ("analysis_bucket",), buckets: int = 64,
                fmt: str = "parquet") -> None:
    """Write in partitions of recordings.

    A folder per recording would be too many small files, so recordings hash
    into a fixed number of buckets, and rows are sorted so that Parquet
    statistics prune inside a bucket.
    """
    out = df
    if "analysis_bucket" in partition_by:
        out = with_bucket(df, buckets)
    # A rebalancing exchange lets AQE cut a bucket with a long recording into several
    # files of the advisory size, and put small buckets together.
    out.hint("rebalance", *[F.col(c) for c in partition_by]).sortWithinPartitions(
        *partition_by, *[c for c in ("analysis_id", "frame", "start_frame") if c in df.columns]
    ).write.mode(mode).partitionBy(*partition_by).format(fmt).save(path)


def with_bucket(df: DataFrame, buckets: int = 64) -> DataFrame:
    return df.withColumn("analysis_bucket", F.pmod(F.xxhash64("analysis_id"), F.lit(buckets)).cast("int"))


def scan(df: DataFrame, analysis_ids: Sequence, buckets: int = 64) -> DataFrame:
    """Rows of the named recordings; prunes bucket folders where the table has them."""
    # The hash depends on the type, so the literals take the column's.
    kind = df.schema["analysis_id"].dataType
    rows = df.where(F.col("analysis_id").isin(*analysis_ids))
    if "analysis_bucket" in df.columns:
        wanted = reduce(lambda a, b: a | b, [
            F.col("analysis_bucket") == F.pmod(F.xxhash64(F.lit(a).cast(kind)), F.lit(buckets)).cast("int")
            for a in analysis_ids])
        rows = rows.where(wanted)
    return rows


def with_dense_id(rows: DataFrame, columns: Sequence[str], out: str, first: int = 0, buckets: int = ID_BUCKETS) -> DataFrame:
    """``out``: numbers without gaps from ``first`` on, one for each value of ``columns``.

    Values are dealt by a hash over buckets and ranked inside them; a bucket's numbers begin
    where those of the buckets before it end, so two values never get one number, however
    many rows there are.  The same rows get the same numbers on every run.  Each bucket is
    sorted in one task, and so are the buckets' sizes.
    """
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
    ranked = rows.withColumn("__bucket", bucket).withColumn(
        "__rank", F.dense_rank().over(Window.partitionBy("__bucket").orderBy(*columns)).cast("long"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy(F.col("__bucket").alias("__b")).agg(F.max("__rank").alias("__n")).select(
        "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = ranked.join(offsets, F.col("__bucket") == F.col("__b"))
    return numbered.select(*rows.columns, (F.col("__offset") + F.col("__rank") + (first - 1)).alias(out))


def intervals_with_participants(intervals: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(intervals, participants) with ids numbered from ``first`` on, from intervals that hold id arrays."""
    keyed = with_dense_id(intervals, ["analysis_id", "relation_type", "participants", "start_frame"], "relation_id", first)
    children = keyed.select("relation_id", "analysis_id",
                            F.explode(F.array_distinct("participants")).alias("class_id"))
    return keyed.drop("participants"), children


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key.  An aggregate, so copies fold before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("__first")).select(
        *[F.col(c) if c in keys else F.col(f"__first.{c}") for c in rows.columns])


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old and new rows merged; the highest version of a key wins."""
    both = old.unionByName(new)
    rest = [version, *[c for c in both.columns if c not in keys and c != version]]
    return both.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__last")).select(
        *[F.col(c) if c in keys else F.col(f"__last.{c}") for c in both.columns])


def delete_recordings(intervals: DataFrame, participants: DataFrame,
                      doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed recordings; participants follow their intervals."""
    kept = intervals.join(doomed.select("analysis_id").distinct(), "analysis_id", "left_anti")
    gone = intervals.join(doomed.select("analysis_id").distinct(), "analysis_id", "left_semi")
    return kept, participants.join(gone.select("relation_id"), "relation_id", "left_anti")


def unprocessed(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Input rows of recordings that have no stored rows yet."""
    return inputs.join(stored.select("analysis_id").distinct(), "analysis_id", "left_anti")


def clean_expected(raw: DataFrame, need_audio: bool = False) -> DataFrame:
    """Expected events: rows with a scene (as int), optionally only those with audio."""
    rows = raw.na.drop(subset=["scene"]).withColumn("scene", F.col("scene").cast("int"))
    if need_audio:
        rows = rows.where(F.col("audio").isNotNull() & (F.col("audio") != ""))
    return rows


def clean_ground_truth(raw: DataFrame, modality: str) -> DataFrame:
    """Annotated intervals of one modality: rows with a scene, class text canonical."""
    return raw.na.drop(subset=["scene"]).where(F.col("modality") == modality).withColumn(
        "scene", F.col("scene").cast("int")).withColumn("class", canonical_class(F.col("class")))


def rekey(runs: Sequence[DataFrame], prefix: str) -> DataFrame:
    """Several runs as one table, ids rewritten from their ``..._s<scene>`` ending."""
    scene = F.regexp_extract("analysis_id", r"_s(\d+)[^_]*$", 1)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    return merged.withColumn("analysis_id", F.when(
        scene != "", F.concat(F.lit(prefix + "_s"), scene)).otherwise(F.col("analysis_id")))


def json_records(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return rows.select(*keep, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record"))


def export_by(rows: DataFrame, path: str, column: str = "scene", fmt: str = "json") -> None:
    rows.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def row_counts(tables: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per table and key, long form."""
    parts = [df.groupBy(*keys, F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def runs_newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "analysis_id")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs_newest_first(runs).limit(1)


def catalogue(specs: DataFrame) -> DataFrame:
    return specs.orderBy("condition", "id")
