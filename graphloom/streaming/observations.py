"""File observations as a stream that keeps the state of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.incremental import digest


def read_observations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def latest_states(observations: DataFrame) -> DataFrame:
    """The newest digest of each path: path, digest, indexed_at (for update or complete output)."""
    rows = observations.filter("path is not null and content_hash is not null and indexed_at is not null")
    return rows.groupBy("path").agg(F.max_by(digest(F.col("content_hash")), F.struct("indexed_at", "obs_id")).alias("digest"), F.max("indexed_at").alias("indexed_at"))


def runs_per_hour(observations: DataFrame, late: str = "6 hours") -> DataFrame:
    """Observations per hour of indexing, closed when the watermark has passed: hour, n."""
    timed = observations.withColumn("seen_at", F.timestamp_millis("indexed_at")).withWatermark("seen_at", late)
    return timed.groupBy(F.window("seen_at", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def write_batches(stream: DataFrame, target: str, checkpoint: str):
    """Each micro-batch to a folder named after it, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
