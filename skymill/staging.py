"""Keeping a table that several later steps read, so that what came before runs once."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skymill-")


def prepare(spark: SparkSession) -> None:
    """Name a checkpoint folder where none is named; on a cluster it has to be shared, so there the setting must be made."""
    if spark.sparkContext.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(base or _own_folder())


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder: a lost executor costs a re-read."""
    prepare(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, as a full URI; deleted when the application ends."""
    prepare(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/skymill-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet beside the checkpoints: for large tables, since checkpoints are not compressed."""
    path = f"{folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
