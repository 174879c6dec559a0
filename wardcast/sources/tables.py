"""Typed tables: conform to a schema, check keys, load so that a second run changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions import null_if_not_finite
from wardcast.schemas import TableDef
from wardcast.sources.storage import remove, replaced, scratch


class DuplicateKeyError(ValueError):
    """A table declared unique on some columns has repeated values in them."""


def _typed(field: T.StructField, kinds: Mapping[str, T.DataType]) -> Column:
    if field.name not in kinds:
        return F.lit(None).cast(field.dataType)
    value, kind = F.col(field.name), kinds[field.name]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = null_if_not_finite(value)
    if isinstance(kind, T.FractionalType) and isinstance(field.dataType, T.IntegralType):
        return F.round(value, 0).try_cast(field.dataType)
    return value.try_cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """The schema's columns, in order and typed. Missing ones are NULL, others are dropped, NaN
    becomes NULL. A value that does not fit fails the job, or becomes NULL if not ``strict``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not any(f.name in kinds for f in schema.fields):
        raise ValueError(f"none of the expected columns are present: {schema.fieldNames()}")
    given = {f.name: F.col(f.name).alias(f"{f.name}__given") for f in schema.fields if f.name in kinds}
    typed = df.select(*[_typed(f, kinds).alias(f.name) for f in schema.fields], *given.values())
    return typed.select(*[_fitting(f, kinds, strict).alias(f.name, metadata=dict(f.metadata)) for f in schema.fields])


def _fitting(field: T.StructField, kinds: Mapping[str, T.DataType], strict: bool) -> Column:
    """The typed value if it says what was given, else an error or NULL."""
    result = F.col(field.name)
    if field.name not in kinds:
        return result
    given = F.col(f"{field.name}__given")
    present = given.isNotNull()
    if isinstance(kinds[field.name], (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(given)
    bad = present & result.isNull()
    length = field.metadata.get("max_length")
    if length:
        bad = bad | (F.length(result) > length)
    if not strict:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(result)
    message = F.concat(F.lit(f"{field.name}: value does not fit {field.dataType.simpleString()}: "), given.cast("string"))
    return F.when(bad, F.raise_error(message).cast(field.dataType)).otherwise(result)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def asserted_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows, of which each key value has one: a repeated one fails the job that reads them.

    Part of the plan, so nothing runs while it is built. Rows are counted by key map-side first, so a hot value does
    not matter.
    """
    rest = [c for c in df.columns if c not in key]
    copies = F.count(F.lit(1)).alias("_copies")
    once = df.groupBy(*key).agg(copies, *[F.first(c).alias(c) for c in rest])
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in key])
    message = F.concat(F.lit(f"repeated key ({', '.join(key)}): "), shown)
    return once.where(F.when(F.col("_copies") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*df.columns)


def audited(stored: DataFrame, key: Sequence[str] = ()) -> int:
    """The number of rows, after a check that no key value repeats; one pass over the key columns."""
    if not key:
        return stored.count()
    copies = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    found = copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count_if(F.col("copies") > 1).alias("repeated")).first()
    if found["repeated"]:
        sample = [row.asDict() for row in duplicate_keys(stored, key).orderBy(F.col("copies").desc(), *key).limit(5).collect()]
        raise DuplicateKeyError(f"repeated key {tuple(key)}: {sample}")
    return found["rows"]


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet directory; with partition columns, only the partitions present in ``df``.

    The rebalance hint lets Spark size the files: it splits a large partition and merges small ones. ``sort_by`` orders
    the rows within each file, so that readers skip the row groups whose range a test on these columns rules out.
    Files appear when all are written: if that fails, what is there stays.
    """
    if not partition_by:
        replaced(df.sparkSession, path, lambda beside: _laid_out(df, (), sort_by).write.parquet(beside))
        return
    writer = _laid_out(df, partition_by, sort_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def _laid_out(df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str]) -> DataFrame:
    rows = df.hint("rebalance", *partition_by) if partition_by or sort_by else df
    # Files are written a partition at a time, so the order within files begins with what they are split by.
    return rows.sortWithinPartitions(*partition_by, *sort_by) if sort_by else rows


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV directory with a header in each file; if writing fails, what is there stays."""
    replaced(df.sparkSession, path, lambda beside: df.write.option("header", True).csv(beside))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


class UnexpectedHeaderError(ValueError):
    """A CSV header names a column that the table does not have."""


def csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The column names in the header of the first file."""
    return spark.read.option("header", True).csv(path).columns


#: Text of a CSV row with a cell that its column's type cannot hold, or with too few or too many cells.
UNREADABLE = "unreadable"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, keep_unreadable: bool = False) -> DataFrame:
    """The schema's columns of a CSV table, matched by the names in its header, in any order.

    Columns that the files lack are NULL. A header with another name, or one that differs from that of the
    first file, raises. So does a row with an unreadable cell, with its text; with ``keep_unreadable`` such rows stay,
    their unreadable cells NULL and their text in a further column, which is NULL for the others.
    """
    header = csv_header(spark, path)
    unknown = [name for name in header if name not in schema.names]
    if unknown:
        raise UnexpectedHeaderError(f"{path}: {unknown} are not among {schema.names}")
    text = T.StructField(UNREADABLE, T.StringType())
    if not header:
        return spark.createDataFrame([], T.StructType([*schema.fields, *([text] if keep_unreadable else [])]))
    reader = spark.read.schema(T.StructType([*[schema[name] for name in header], text])).option("header", True)
    rows = reader.options(enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=UNREADABLE).csv(path)
    named = [(F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    # Only cells that a query needs are parsed, and one that needs just this column is refused. So the text takes
    # no characters of a value that all cells go into.
    none = F.substring(F.xxhash64(*header).cast("string"), 1, 0)
    broken = F.concat(F.col(UNREADABLE), none)
    if keep_unreadable:
        return rows.select(*named, broken.alias(UNREADABLE))
    readable = F.when(broken.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unreadable row: "), broken)).cast("boolean"))
    return rows.where(readable).select(*named)


def csv_quality(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row: rows, rows with an unreadable cell, and the first text among those."""
    rows = read_csv(spark, path, schema, keep_unreadable=True)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(UNREADABLE).alias("unreadable_rows"), F.min(UNREADABLE).alias("example"))


def loadable(df: DataFrame, table: TableDef, renames: Mapping[str, str] | None = None) -> DataFrame:
    """The rows as the table takes them: columns renamed and conformed, and its key asserted."""
    rows = conform(df.withColumnsRenamed(dict(renames or {})), table.schema)
    return asserted_unique(rows, table.key) if table.key else rows


@contextmanager
def staged(df: DataFrame, table: TableDef, place: str) -> Iterator[DataFrame]:
    """The conformed rows, written once to ``place`` and read from there. The files go if anything fails."""
    spark = df.sparkSession
    rows = conform(df, table.schema)
    try:
        writer = _laid_out(rows, table.partition_by, table.sort_by).write
        (writer.partitionBy(*table.partition_by) if table.partition_by else writer).parquet(place)
        yield spark.read.schema(rows.schema).parquet(place)
    except BaseException:
        remove(spark, place)
        raise


def load_table(df: DataFrame, name: str, table: TableDef, renames: Mapping[str, str] | None = None) -> int:
    """Write ``df`` to the catalog table ``name`` and return the number of rows loaded.

    Loading the same data twice leaves the table as after the first load: partitioned tables
    replace the partitions present in ``df``, others are replaced whole.

    The input is evaluated once: rows are written to a place of their own beside the table, their key and number are
    taken from the written files, and then they are published. A table without partitions is pointed at the new files,
    of a partitioned one the partitions are replaced when all of them are copied. A load that fails before leaves the
    table as it was.
    """
    spark = df.sparkSession
    database, _, own = name.rpartition(".")
    home = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    place = f"{home.rstrip('/')}/{own}-{uuid.uuid4()}"
    with staged(df.withColumnsRenamed(dict(renames or {})), table, place) as rows:
        loaded = audited(rows, table.key)
        if not spark.catalog.tableExists(name):
            _create(spark, name, table)
        old = _location(spark, name)
        if table.partition_by:
            rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
        else:
            spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(place)}")
    spark.catalog.refreshTable(name)
    remove(spark, place if table.partition_by else old)
    describe_table(spark, name, table)
    return loaded


def _create(spark: SparkSession, name: str, table: TableDef) -> None:
    create = spark.createDataFrame([], table.schema).write.format("parquet").mode("errorifexists")
    if table.partition_by:
        # Kept with the table: an overwrite replaces the partitions it has rows for.
        create = create.option("partitionOverwriteMode", "dynamic").partitionBy(*table.partition_by)
    create.saveAsTable(name)


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[-1]["data_type"]


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def describe_table(spark: SparkSession, name: str, table: TableDef) -> list[str]:
    """Bring the comments of the table and its columns up to the schema's, and return the names of what has changed:
    columns, and the table's own name. What is described already is left alone."""
    changed = []
    if (spark.catalog.getTable(name).description or "") != table.comment:
        spark.sql(f"COMMENT ON TABLE {name} IS {_quoted(table.comment)}")
        changed.append(name)
    there = {c.name: c.description or "" for c in spark.catalog.listColumns(name)}
    for field in table.schema.fields:
        wanted = field.metadata.get("comment", "")
        if field.name in there and there[field.name] != wanted:
            spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{field.name}` COMMENT {_quoted(wanted)}")
            changed.append(field.name)
    return changed


def descriptions(spark: SparkSession, name: str) -> DataFrame:
    """(column, type, comment) of a catalog table, as the catalog has them."""
    rows = [(c.name, c.dataType, c.description) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "column string, type string, comment string")


def write_jdbc(df: DataFrame, url: str, name: str, properties: Mapping[str, str], table: TableDef, batch_size: int = 500) -> None:
    """Append the conformed rows to a database table, in batches.

    A database has no partitions to replace, so unlike ``load_table`` a second run appends the rows again,
    or fails where the database holds the table's key unique. Empty the table first to load it anew. The rows are
    staged and their key is checked before the first one is sent.
    """
    place = scratch(df.sparkSession, "jdbc")
    with staged(df, table, place) as rows:
        audited(rows, table.key)
        rows.write.option("batchsize", batch_size).jdbc(url, name, mode="append", properties=dict(properties))
    remove(df.sparkSession, place)


def profile(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def preview(df: DataFrame, order_by: Sequence[Column], rows: int = 5) -> DataFrame:
    """The first rows in a given order."""
    return df.orderBy(*order_by).limit(rows)


def json_rows(df: DataFrame, section: str | None = None) -> DataFrame:
    """One JSON object per row, keys in lower case, NULL fields kept."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body")
    return lowered.select(body) if section is None else lowered.select(F.lit(section).alias("section"), body)


def json_sections(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Several result sets as one table of (section, body)."""
    return reduce(DataFrame.unionByName, [json_rows(df, name) for name, df in frames.items()])


def write_json_sections(frames: Mapping[str, DataFrame], path: str) -> None:
    """One directory of JSON lines per section."""
    json_sections(frames).write.mode("overwrite").partitionBy("section").text(path)
