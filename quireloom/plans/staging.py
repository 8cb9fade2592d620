"""Intermediate tables written where every executor can read them.

A plan that reads one intermediate result several times writes it once and reads the files. The folder is the one the
cluster names in ``spark.checkpoint.dir``; without it a temporary folder is made, but only for a local master, where
driver and executors share a disk. Files survive the loss of executors, unlike cached blocks, and cut the lineage. They are
deleted when the application ends, or earlier by clear_stages.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_cleared_at_exit: set[str] = set()


def _shared_folder(spark: SparkSession) -> str:
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="quireloom-stage-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _cleared_at_exit:
        return
    _cleared_at_exit.add(folder)

    def clear() -> None:
        with suppress(Exception):  # a context that is gone can delete nothing any more
            _delete(spark, folder)

    atexit.register(clear)
    stop = spark.sparkContext.stop

    def stop_after_clearing() -> None:
        clear()
        stop()

    spark.sparkContext.stop = stop_after_clearing


def _application_folder(spark: SparkSession) -> str:
    return f"{_shared_folder(spark)}/quireloom/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of the files."""
    spark = df.sparkSession
    folder = _application_folder(spark)
    _clear_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged; results that still read it must have been written before."""
    _delete(spark, _application_folder(spark))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver uses.

    On a cluster where that folder is absent, pass the package with ``--py-files``; this setting then has no effect.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
