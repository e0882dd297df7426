"""Running a stream over what is already there, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import scratch_dir
from spanloom.streaming.closing import use_state_store


def drain(spark: SparkSession, stream: DataFrame, progress: list | None = None) -> DataFrame:
    """Process all available input and return what the exactly-once file sink has written.

    ``progress`` receives Spark's report of each batch, with the rows its state holds.
    """
    use_state_store(spark)
    out, state = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-state")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(
        availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(out)
