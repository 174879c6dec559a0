"""Landing files: one directory tree partitioned by state, year and month, whose columns may differ."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.schemas import LANDING_PARTITIONS, RAW
from wardcast.sources.storage import first_line
from wardcast.sources.tables import read_csv

# So many CSV headers are read at once.
PROBES = 16


class NoRowsError(RuntimeError):
    """The selection matched no admissions."""


#: What is known of a landing directory: its listing when its columns were looked at, and the columns.
LEDGER = T.StructType(
    [
        T.StructField("directory", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("changed", T.TimestampType()),
        T.StructField("files", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("columns", T.StringType()),
    ]
)


def read_admissions(
    spark: SparkSession,
    path: str,
    *,
    states: Sequence[str] = (),
    years: Sequence[int] = (),
    months: Sequence[int] = (),
    file_format: str = "parquet",
    fields: T.StructType = RAW,
    ledger: str | None = None,
) -> DataFrame:
    """Admissions of the given states, years and months, every field as text.

    The three selections are partition columns, so other directories are not read. Columns are matched by
    name: files may lack some of the fields, which read as NULL there, may have them in any order, and may
    have other ones, which are dropped. Parquet fields may have any type, the same within a directory: one that
    has two there raises. Directories whose columns agree are one scan; within a directory, a CSV header that
    differs raises.

    The columns of all directories are looked at in one job, or a few where types differ between them. With a
    ``ledger``, a Parquet table kept at that path, only directories that it does not know, or whose files have changed
    since, are looked at, and are added to it.
    """
    selection = {"state": {str(s) for s in states}, "year": {str(y) for y in years}, "month": {str(m) for m in months}}
    kinds = _kinds(spark, path, selection, file_format, ledger)
    if not kinds:
        return spark.createDataFrame([], T.StructType([*fields.fields, *LANDING_PARTITIONS.fields]))
    groups = []
    for found, directories in kinds:
        rows = spark.read.option("basePath", path).option("header", True).option("enforceSchema", False).format(file_format)
        rows = rows.schema(T.StructType(found.fields + LANDING_PARTITIONS.fields)).load(sorted(directories))
        named = [(F.col(f.name) if f.name in found.names else F.lit(None)).cast("string").alias(f.name) for f in fields.fields]
        rows = rows.select(*named, *LANDING_PARTITIONS.names)
        for name, wanted in (("state", states), ("year", years), ("month", months)):
            if wanted:
                rows = rows.where(F.col(name).isin(*wanted))
        groups.append(rows)
    return reduce(DataFrame.unionByName, groups)


def _selected(directory: str, selection: dict[str, set[str]]) -> bool:
    """Whether the directory's name leaves it in the selection."""
    values = dict(part.split("=", 1) for part in unquote(directory).split("/") if "=" in part)
    values = {k: v.lstrip("0") if v.isdigit() else v for k, v in values.items()}
    return all(not wanted or values.get(name) in wanted for name, wanted in selection.items())


def _kinds(
    spark: SparkSession, path: str, selection: dict[str, set[str]], file_format: str, ledger: str | None
) -> list[tuple[T.StructType, list[str]]]:
    """The selected directories, together where one list of columns reads them all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(
        F.max("modificationTime").alias("changed"),
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max_by("path", F.struct("length", "path")).alias("largest"),
    )
    key = ["directory", "format", "changed", "files", "bytes"]
    listed = listed.withColumn("format", F.lit(file_format))
    known = None if ledger is None else read_optional(spark, ledger, LEDGER)
    if known is not None:
        listed = listed.join(known.dropDuplicates(key), key, "left")
    else:
        listed = listed.withColumn("columns", F.lit(None).cast("string"))
    rows = [r for r in listed.orderBy("directory").collect() if _selected(r["directory"], selection)]
    kinds = [(T.StructType.fromJson(json.loads(r["columns"])), [r["directory"]]) for r in rows if r["columns"]]
    new = [r for r in rows if not r["columns"]]
    if new:
        look = _csv_columns if file_format == "csv" else _merged_columns
        seen = look(spark, [(r["directory"], r["largest"]) for r in new], file_format)
        if ledger is not None:
            of = {d: columns.json() for columns, directories in seen for d in directories}
            added = [(*[r[k] for k in key], of[r["directory"]]) for r in new]
            spark.createDataFrame(added, LEDGER).coalesce(1).write.mode("append").parquet(ledger)
        kinds += seen
    return _together(kinds, merge=file_format != "csv")


def _merged_columns(spark: SparkSession, directories: list[tuple[str, str]], file_format: str) -> list[tuple[T.StructType, list[str]]]:
    """The columns of the directories' files, together: one job reads the footers of all of them. Where a column has
    two types, the directories are halved, so the number of jobs grows with the changes of type, not with directories."""
    names = [d for d, _ in directories]
    try:
        found = spark.read.option("mergeSchema", True).format(file_format).load(names).schema
    except Exception as error:
        if len(names) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
        half = len(names) // 2
        parts = directories[:half], directories[half:]
        return [kind for part in parts for kind in _merged_columns(spark, part, file_format)]
    return [(_without_partitions(found), names)]


def _csv_columns(spark: SparkSession, directories: list[tuple[str, str]], file_format: str) -> list[tuple[T.StructType, list[str]]]:
    """The header of each directory's largest file; no job is started for it. The reader compares those of the others."""

    def columns(directory: tuple[str, str]) -> tuple[T.StructType, list[str]]:
        line = first_line(spark, directory[1]) or ""
        names = next(csv.reader([line.lstrip("\ufeff")]), [])
        return _without_partitions(T.StructType([T.StructField(n, T.StringType()) for n in names])), [directory[0]]

    with ThreadPoolExecutor(PROBES) as pool:
        return list(pool.map(columns, directories))


def _without_partitions(found: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in found.fields if f.name not in LANDING_PARTITIONS.names])


def _together(kinds: Iterable[tuple[T.StructType, list[str]]], *, merge: bool) -> list[tuple[T.StructType, list[str]]]:
    """Directories with the same columns together; with ``merge``, also those that lack some, if the types agree."""
    out: list[tuple[dict[str, T.DataType], list[str]]] = []
    for columns, directories in kinds:
        own = {f.name: f.dataType for f in columns.fields}
        for there, others in out:
            if list(there.items()) == list(own.items()) if not merge else all(there.get(n, t) == t for n, t in own.items()):
                there.update(own)
                others.extend(directories)
                break
        else:
            out.append((own, list(directories)))
    return [(T.StructType([T.StructField(n, t) for n, t in columns.items()]), directories) for columns, directories in out]


def union_months(frames: Iterable[DataFrame]) -> DataFrame:
    """One table from monthly ones whose columns may differ. Files under one landing tree need no
    union: ``read_admissions`` scans them together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_rows(df: DataFrame, what: str = "the selection") -> DataFrame:
    """Raise unless there is at least one row. Stops at the first row found."""
    if df.isEmpty():
        raise NoRowsError(f"{what} has no rows; check states, years, months and the path")
    return df


def read_optional(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if the path does not exist."""
    try:
        return read_csv(spark, path, schema) if file_format == "csv" else spark.read.schema(schema).format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def inline_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """Parameters and lookups typed in as rows."""
    return spark.createDataFrame(list(rows), schema)
