"""Indicators from partial states that are kept for each landing file.

A state is what the rows of a landing file add to a group: counts, exact sums, and how many values were known. States of
any landing files merge into the indicators of all their rows, so a new or replaced month costs one pass over that month
and a merge of the small states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions import half_up
from wardcast.operators.indicators import VIEW_KEYS
from wardcast.schemas import COHORT, COHORT_PARTITIONS
from wardcast.sources import tables
from wardcast.sources.storage import remove

SUM = T.DecimalType(25, 2)
MEASURES = {
    "admissions": T.LongType(),
    "coded": T.LongType(),
    "value_sum": SUM,
    "values": T.LongType(),
    "stay_sum": T.LongType(),
    "stays": T.LongType(),
    "deaths": T.LongType(),
}


def states_schema(keys: Sequence[str] = VIEW_KEYS, per: Sequence[str] = COHORT_PARTITIONS) -> T.StructType:
    known = [T.StructField(k, COHORT[k].dataType) for k in keys]
    measures = [T.StructField(n, t) for n, t in MEASURES.items()]
    return T.StructType([*known, *measures, *[T.StructField(p, COHORT[p].dataType) for p in per]])


def admission_states(clean: DataFrame, keys: Sequence[str] = VIEW_KEYS, per: Sequence[str] = COHORT_PARTITIONS) -> DataFrame:
    """One row for each landing file and group. Measures that ``clean`` lacks are unknown in all its rows."""

    def known(name: str) -> Column:
        return F.col(name) if name in clean.columns else F.lit(None).cast(COHORT[name].dataType)

    out = clean.groupBy(*keys, *per).agg(
        F.count(F.lit(1)).alias("admissions"),
        F.count("diag_code").alias("coded"),
        F.sum(known("total_value")).cast(SUM).alias("value_sum"),
        F.count(known("total_value")).alias("values"),
        F.sum(known("stay_days")).alias("stay_sum"),
        F.count(known("stay_days")).alias("stays"),
        F.sum(known("death")).alias("deaths"),
    )
    return out.select(*keys, *MEASURES, *per)


def write_states(states: DataFrame, path: str, per: Sequence[str] = COHORT_PARTITIONS, emptied: Sequence[dict] = ()) -> None:
    """Put the states in place of those of the same landing files.

    A landing file of which no row is left in the cohort has no state to put there: name it in ``emptied`` by its
    partition values, and what is kept of it goes.
    """
    tables.write_parquet(states, path, per)
    for values in emptied:
        remove(states.sparkSession, "/".join([path.rstrip("/"), *[f"{p}={values[p]}" for p in per]]))


def read_states(spark: SparkSession, path: str, keys: Sequence[str] = VIEW_KEYS, per: Sequence[str] = COHORT_PARTITIONS) -> DataFrame:
    return tables.read_parquet(spark, path, states_schema(keys, per))


def _mean(total: str, count: str, digits: int) -> Column:
    """As ``exact_mean``, of sums of sums."""
    return half_up(F.try_divide(F.sum(total).cast(SUM), F.sum(count).cast("decimal(15,0)")), digits)


def merged_admissions(states: DataFrame, keys: Sequence[str] = VIEW_KEYS) -> DataFrame:
    """``indicators.grouped_admissions`` of the rows that the states stand for."""
    view = states.groupBy(*keys).agg(
        F.sum("admissions").alias("admissions"),
        F.sum("value_sum").cast(SUM).alias("total_cost"),
        _mean("value_sum", "values", 2).cast("decimal(15,2)").alias("mean_cost"),
        _mean("stay_sum", "stays", 1).cast("decimal(8,1)").alias("mean_stay"),
        F.sum("deaths").alias("deaths"),
    )
    return view.orderBy(F.col("year").asc_nulls_last())


def merged_history(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``indicators.yearly_history`` of the rows that the states stand for."""
    history = states.where(F.col("year").isNotNull()).groupBy(*keys, "year").agg(
        F.sum("coded").alias("admissions"),
        _mean("value_sum", "values", 2).cast("decimal(15,2)").alias("mean_value"),
        _mean("stay_sum", "stays", 2).cast("decimal(8,2)").alias("mean_stay"),
    )
    return history.orderBy(*keys, F.col("year").asc_nulls_last())
