"""Every registered query of the package that SQL can express, compared with it row by row."""

from __future__ import annotations

import pytest

from tests.compare import connect, spark_result, sql_result
from wardcast.llm.queries import CHECK_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    columns, rows = spark_result(QUERIES[name](spark, sf_dir))
    expected, wanted = sql_result(connect(sf_dir), CHECK_SQL[name])
    assert columns == expected
    assert rows == wanted
