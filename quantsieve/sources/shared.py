"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop has them: any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all of Spark is one local process (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quantsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's intermediate tables; it goes when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/quantsieve-{spark.sparkContext.applicationId}"
    path, fs = hadoop(spark, folder)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path for an intermediate table that nothing else uses."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: once results are written, nothing reads them any more."""
    path, fs = hadoop(spark, own_dir(spark))
    for found in fs.listStatus(path):
        fs.delete(found.getPath(), True)
