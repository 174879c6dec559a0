"""Exact comparison of a Spark result with an SQL engine's, ignoring row and column order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


KIND = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE",
}


def spark_result(df):
    names = sorted(df.columns)
    kinds = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rows = Counter(tuple(cell(r[n]) for n in names) for r in df.select(*names).collect())
    return {n: kinds[n] for n in names}, rows


def sql_result(con, sql):
    cursor = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = Counter(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    return {columns[i][0]: columns[i][1] for i in order}, rows
