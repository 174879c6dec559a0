"""Places of rows in order, without one task that sees them all.

Rows are range-partitioned and sorted, each partition numbers its own rows, and what the earlier partitions hold of a
group is added. No task sees more of a group than its range, however much of the table the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardcast.llm.exchange import partitions
from wardcast.llm.storage import saved

#: So many rows of a range are sorted in a task.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``at``, their place in their group from 0, and ``of``, the number of rows in it.

    ``group`` holds no nulls; nulls in ``order`` come first. Rows equal in all of it are placed in any order, and do
    not share a range, since each row has a number of its own that is written before the rows are dealt. The result
    is written, so it stays the same when tasks are repeated.
    """
    kept = saved(rows.withColumn("_own", F.monotonically_increasing_id()))
    n = max(partitions(rows.sparkSession), -(-kept.count() // RANGE_ROWS))
    by = [group, *order, "_own"]
    dealt = kept.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_own")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = saved(dealt.withColumns({"_part": F.spark_partition_id(), "_row": row}))
    ranges = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")
    starts = ranges.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("of"))
    found = placed.join(starts, [group, "_part"])
    return saved(found.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("at"), "of"))
