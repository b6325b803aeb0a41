"""Session defaults, staged tables, and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: str | None = None
_SHIPPED: set[str] = set()


def build_session(master: str | None = None, app_name: str = "ratecraft", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once per application.

    Workers import the modules of pandas UDFs by name; without this they would need the package on their own path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ratecraft-ship-")
    archive = shutil.make_archive(os.path.join(folder, "ratecraft"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a single-machine session gets a folder of its own; a cluster gets an error, because its executors
    would each write to their own disk.
    """
    global _LOCAL_FOLDER
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="ratecraft-stage-")
    return _LOCAL_FOLDER


def stage(df: DataFrame) -> DataFrame:
    """Writes a frame several outputs are built from as a table in the shared folder and reads it back.

    The source is then read once, lost executors cost no recomputation of it, and later joins see columns, filters and
    true sizes of a parquet table.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by a hash of ``columns`` to as many tasks as the session shuffles to.

    A file of repeated cells is small, so one task may hold millions of its rows; work that is long for each row starts here.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
