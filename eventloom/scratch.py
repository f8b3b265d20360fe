"""Tables written to the shared folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder. Where it is unset, executors of a cluster would write to their own disks: that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master or 'a cluster'} it has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the session ends."""
    path = f"{root(spark)}/eventloom-{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path, on whatever file system it lies; a stopped session leaves it to the cluster's own cleaning."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
