"""Structured Streaming over a landing folder of result files: an extension beside the batch workflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def per_batch(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Each arriving file set goes through the batch analysis and is appended to ``target``; reruns of a batch overwrite it."""

    def write(df: DataFrame, number: int) -> None:
        analyse(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of a key; works on streams (with a watermark) and on tables."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    grouped = timed.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
