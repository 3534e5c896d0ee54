"""Structured Streaming jobs: windowed counts of events, and incremental ingest that skips what is known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and values per hour and type, with a watermark for late rows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result; for results of bounded size."""
    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def ingest(stream: DataFrame, known_path: str, checkpoint: str) -> None:
    """Appends rows of (doc_id, text) whose text is not in known_path yet, batch by batch; restarts where it stopped."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("content", F.sha2("text", 256)).dropDuplicates(["content"])
        try:
            new = new.join(spark.read.parquet(known_path).select("content"), "content", "left_anti")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("append").parquet(known_path)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
