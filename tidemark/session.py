"""Session helpers of the core package."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. A session on one machine gets one of its own if it names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df by way of a reliable checkpoint, in the folder that the session names for it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system that was made here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
