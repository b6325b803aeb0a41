"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecraft.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def labelled(documents: DataFrame, labels: DataFrame, label: str, modulus: int, limit: int) -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, at most ``limit`` of each label value, chosen by a hash of the id.

    Rows without a label do not teach. Repeated rows count as often as they occur. The bound is a fitting parameter only:
    scoring covers every row.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(remainder("doc_id", modulus) != 0)
    parts = [known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for value in (0, 1)]
    chosen = parts[0].union(parts[1])
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "y")


def map_rows(df: DataFrame, function: Callable[..., list], schema: str, rows: int = 512) -> DataFrame:
    """Applies ``function(*columns) -> list of output columns`` to slices of at most ``rows`` rows inside the tasks.

    Slices bound the memory of a task whatever the size of Spark's batches is. Output columns are lists, arrays or Arrow
    arrays; they need not have as many rows as the input.
    """
    ship_package(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    target = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                out = function(*[column.to_pylist() for column in part.columns])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type, from_pandas=False) for x, f in zip(out, target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, fields)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)
