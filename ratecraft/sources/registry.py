"""Uploaded files: content hashes, and what happened to the same file before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_size, modified, file_hash) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"),
    )


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_key, modified, file_size) of stored files, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_key"), F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"))


def prior_attempts(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each (target_table, file_hash) with its latest prior attempt, NULL where it is new."""
    row = F.struct("created_at", "id")
    last = attempts.groupBy("target_table", "file_hash").agg(
        F.max_by("status", row).alias("prior_status"), F.max_by("row_count", row).alias("prior_row_count"),
        F.max("created_at").alias("prior_at"),
    )
    return files.join(last, ["target_table", "file_hash"], "left")


def completed(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attempts with finished outcomes applied; ``outcomes`` has ``id``, ``success`` and ``rows``."""
    status = F.when(F.col("success").isNull(), F.col("status")).when(F.col("success"), F.lit("COMPLETED")).otherwise(F.lit("FAILED"))
    return attempts.join(outcomes, "id", "left").withColumn("status", status).withColumn(
        "row_count", F.coalesce("rows", "row_count")
    ).drop("success", "rows")
