"""Folders that all hosts share, for tables and files between jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in
    spark.checkpoint.dir; where that is unset, a local one if driver and executors
    are one process (tests), else an error.  It goes when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
        base = getattr(scratch_folder, "local", None)
        if base is None:
            base = scratch_folder.local = "file://" + tempfile.mkdtemp(prefix="textloom-")
    path = f"{base.rstrip('/')}/textloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; a cluster's folder is cleaned by its owner
        pass


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet and read again: what several later steps read is worked
    out once, and its lineage ends."""
    path = path or scratch_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
