"""Files that keep arriving: continuous mapping and rolling failure counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def policy_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Policy files as they arrive in a folder; every cell text, as in the batch scan."""
    return (
        spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def map_stream(policies: DataFrame, map_batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
               available_now: bool = False) -> StreamingQuery:
    """Maps each micro-batch with the batch workflow and writes it under its batch number.

    Rate tables are read by ``map_batch`` itself, so every batch sees the current card. A replayed batch overwrites its own
    folder, so a retry never doubles rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        mapped = map_batch(batch)
        mapped.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = policies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def failure_counts(failed: DataFrame, watermark: str = "2 days", window: str = "1 day") -> DataFrame:
    """(day, status_key, n) of a stream of failed rows with ``uploaded_at``; also runs on a batch frame."""
    rows = failed.withWatermark("uploaded_at", watermark) if failed.isStreaming else failed
    return rows.groupBy(F.window("uploaded_at", window).alias("w"), "status_key").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day"), "status_key", "n"
    )
