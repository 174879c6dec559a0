"""Spark settings that depend on how much data a job reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024
GB = 1024 * MB
# A shuffle partition of this size sorts and aggregates in a task's share of executor memory.
SHUFFLE_PARTITION_BYTES = 256 * MB


def scale_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that reads ``input_bytes`` on ``cores`` cores.

    Input splits grow with the input, so that planning is not swamped by tasks: about four waves of
    tasks, but no split over 1 GB. Shuffles start fine-grained; adaptive execution merges partitions
    up to the advisory size and splits those that hold a hot key.
    """
    split = min(max(input_bytes // max(cores * 4, 1), 32 * MB), GB)
    partitions = max(cores, -(-input_bytes // SHUFFLE_PARTITION_BYTES))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SHUFFLE_PARTITION_BYTES),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """Set what the cluster or the user has not set already."""
    for name, value in settings.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """The size of all files under the paths, from their listing alone: no file is opened."""
    total = 0
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        total += files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return total


def sized(spark: SparkSession, *paths: str, input_bytes: int | None = None) -> SparkSession:
    """The session with the settings for a job that reads the paths, or as many bytes as stated."""
    size = stored_bytes(spark, *paths) if input_bytes is None else input_bytes
    return apply_settings(spark, scale_settings(size, spark.sparkContext.defaultParallelism))
