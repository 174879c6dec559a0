"""All queries on tables where one part, supplier and customer hold a third of the rows and where
values are missing, with every join shuffled."""

from __future__ import annotations

import re

import pytest

from tests.compare import connect, spark_result, sql_result
from wardcast.plans.catalogue import QUERIES
from wardcast.plans.check_sql import CHECK_SQL
from wardcast.sources import star

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "32KB",
}

HOT = {
    "lineitem": """SELECT * EXCLUDE (n) REPLACE (
        CASE WHEN n % 3 = 0 THEN 7 WHEN n % 97 = 0 THEN NULL WHEN n % 101 = 0 THEN -1 ELSE l_partkey END AS l_partkey,
        CASE WHEN n % 3 = 0 THEN 3 WHEN n % 89 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
        CASE WHEN n % 53 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate,
        CASE WHEN n % 59 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
        CASE WHEN n % 61 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
        CASE WHEN n % 67 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber,
        CASE WHEN n % 71 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
      ) FROM (SELECT *, row_number() OVER () AS n FROM base)""",
    "orders": """SELECT * EXCLUDE (n) REPLACE (
        CASE WHEN n % 3 = 0 THEN 5 WHEN n % 31 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
        CASE WHEN n % 37 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate
      ) FROM (SELECT *, row_number() OVER () AS n FROM base)""",
    "part": """SELECT * REPLACE (
        CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) WHEN p_partkey % 13 = 0 THEN ' ' || p_type
          WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type END AS p_type,
        CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS p_brand
      ) FROM base""",
}


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    import duckdb

    base = "/root/testdata/sf0.001"
    out = tmp_path_factory.mktemp("hot")
    with duckdb.connect() as con:
        for name in star.SCHEMAS:
            sql = HOT.get(name, "SELECT * FROM base").replace("base", f"'{base}/{name}.parquet'")
            con.execute(f"COPY ({sql}) TO '{out}/{name}.parquet' (ROW_GROUP_SIZE 2048)")
    return str(out)


@pytest.fixture(scope="module")
def shuffled(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hot_keys_and_missing_values(shuffled, hot_dir, name):
    with connect(hot_dir) as con:
        kinds, rows = spark_result(QUERIES[name](shuffled, hot_dir))
        sql_kinds, sql_rows = sql_result(con, CHECK_SQL[name])
    assert kinds == sql_kinds
    assert rows == sql_rows


def test_hot_part_is_split(shuffled, hot_dir):
    rows = star.admissions(shuffled, hot_dir, ["DIAG_PRINC", "VAL_TOT", "CNES"])
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in plan
    assert re.search(r"AQEShuffleRead.*skewed", plan)
