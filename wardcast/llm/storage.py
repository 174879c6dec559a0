"""Results that later jobs read again, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``. Where none is named, a session within one machine makes one; on a
    cluster that is an error, since executors would not see each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardcast-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; Spark removes them when nothing refers to them any more."""
    folder(df.sparkSession)
    return df.checkpoint()


def fewer(df: DataFrame, amount: int, each: int) -> DataFrame:
    """The rows, of which there is that amount at most, in no more partitions than hold ``each`` of it.

    Keys are dealt into as many partitions as the whole input needs; for what is small beside it, most of their tasks and
    files would be empty.
    """
    return df.coalesce(max(-(-amount // each), 1))


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
