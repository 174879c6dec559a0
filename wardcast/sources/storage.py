"""Folders that the driver and all executors share, and replacing what is in one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the warehouse where none is named: tables are kept there, so it is shared."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder, if it is there."""
    files, place = _place(spark, path)
    files.delete(place, True)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a folder beside ``path`` and put it in its place; if writing fails, what is there stays."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4()}"
    try:
        write(beside)
        files, place = _place(spark, path)
        files.delete(place, True)
        if not files.rename(_place(spark, beside)[1], place):
            raise OSError(f"{beside} could not be moved to {path}")
    except BaseException:
        remove(spark, beside)
        raise


def first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a text file, compressed or not, read on the driver; None if it is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, place = _place(spark, file)
    stream = files.open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        text = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()
