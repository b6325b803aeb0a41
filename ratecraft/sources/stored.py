"""Stored tables that change: hash buckets of a key, and a manifest of each version that names the folder of every bucket.

A change rewrites the buckets it touches into a new folder and then writes its manifest, one small file, which is the commit; a
reader sees the version before or the version after. A change that was committed under its id is not applied again, and what a
failed try left behind is written over. One writer at a time; readers need no lock, and older versions stay readable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratecraft.operators import maintain as M
from ratecraft.session import stage

MANIFEST = "bucket int, folder bigint, rows bigint, change_id string, version bigint"


@dataclass(frozen=True)
class StoredTable:
    """``schema`` is that of the rows, ``key`` the column whose hash deals them to ``buckets``; the manifest has a row a bucket, which
    is what the driver lists. Null keys share a bucket; rows that repeat a key stay."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifests(self) -> DataFrame:
        """(bucket, folder, rows, change_id, version) of every version; a bucket of -1 stands for a table without rows."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """Number of the last committed change, 0 before the first."""
        return self.manifests().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _read(self, version: int, only: list[int] | None = None) -> DataFrame:
        places = self.manifests().where((F.col("version") == version) & (F.col("bucket") >= 0))
        places = places if only is None else places.where(F.col("bucket").isin(only))
        paths = [f"{self.path}/data/folder={r.folder}/bucket={r.bucket}" for r in places.select("bucket", "folder").collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; only its own files are listed and read."""
        return self._read(self.version() if version is None else version)

    def commit(self, change_id: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Applies ``change`` to the rows of all buckets that hold a key of ``touched`` and returns the version that has it.

        ``change`` gets those buckets' rows and must keep rows of other keys, and must not move rows to other buckets than the
        touched ones. No touched bucket: the version is committed without new files.
        """
        log = self.manifests()
        done = log.where(F.col("change_id") == change_id).agg(F.min("version")).first()[0]
        if done is not None:
            return done
        before = self.version()
        own = sorted(r.bucket for r in touched.select(self._bucket()).distinct().collect())
        after = change(self._read(before, own)) if own else self.spark.createDataFrame([], self.schema)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema]
        folder = f"{self.path}/data/folder={before + 1}"
        dealt = after.select(*columns, self._bucket()).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)
        kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in after.select(*columns).schema), "bucket int"])
        written = self.spark.read.schema(kinds).parquet(folder).groupBy("bucket").agg(F.count("*").alias("rows"))
        if written.where(~F.col("bucket").isin(own)).limit(1).count():
            raise ValueError("a change moved rows to a bucket that it did not touch")
        kept = log.where((F.col("version") == before) & ~F.col("bucket").isin(own) & (F.col("bucket") >= 0)).select("bucket", "folder", "rows")
        entries = kept.unionByName(written.select("bucket", F.lit(before + 1).cast("bigint").alias("folder"), "rows"))
        none = self.spark.createDataFrame([(-1, 0, 0)], "bucket int, folder bigint, rows bigint")
        entries = stage(entries.unionByName(none).withColumn("change_id", F.lit(change_id)))
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={before + 1}")
        return before + 1

    # ---- changes ------------------------------------------------------------------------------------
    def insert(self, change_id: str, rows: DataFrame) -> int:
        return self.commit(change_id, rows, lambda old: old.unionByName(rows.select(*old.columns)))

    def upsert(self, change_id: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """``apply(old, changes)`` over the buckets that hold a key of ``changes``; it matches rows by the table's key."""
        changes = stage(changes)
        return self.commit(change_id, changes, lambda old: apply(old, changes))

    def set_field(self, change_id: str, keys: DataFrame, field: str, text: str) -> int:
        """Sets an allow-listed field on the rows behind selected keys (``wanted``): a group id first, else a row id."""
        hits = stage(M.selected_rows(self.read().select("id", "group_id"), keys))
        return self.commit(change_id, hits, lambda old: M.set_field(old, hits, field, text))

    def purge(self, change_id: str, where: Column) -> int:
        """Drops the rows for which ``where`` is true."""
        return self.commit(change_id, self.read().where(where), lambda old: old.where(~F.coalesce(where, F.lit(False))))
