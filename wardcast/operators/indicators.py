"""Observed indicators: per year, per group, and per 100 thousand inhabitants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions import exact_mean, half_even, in_millions
from wardcast.spec import ProjectionSpec

VIEW_KEYS = ("year", "diag_group", "diag_label", "age_band")


def yearly_history(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Admissions, mean amount and mean stay per year (and key). Rows without a year are left out;
    a measure whose column is absent is NULL."""
    present = set(clean.columns)
    mean_value = exact_mean(F.col("total_value"), 2) if "total_value" in present else F.lit(None)
    mean_stay = exact_mean(F.col("stay_days"), 2) if "stay_days" in present else F.lit(None)
    return (
        clean.groupBy(*keys, "year")
        .agg(
            F.count("diag_code").alias("admissions"),
            mean_value.cast("decimal(15,2)").alias("mean_value"),
            mean_stay.cast("decimal(8,2)").alias("mean_stay"),
        )
        .where(F.col("year").isNotNull())
        .orderBy(*keys, F.col("year").asc_nulls_last())
    )


def grouped_admissions(clean: DataFrame, keys: Sequence[str] = VIEW_KEYS) -> DataFrame:
    """Admissions, cost, stay and deaths per year, diagnosis and age band. NULL keys form groups.

    Sums are combined per task before the shuffle, so a group holding most rows costs no more. The
    order by year is dropped by Spark where the view feeds another aggregate.
    """
    view = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("admissions"),
        F.sum("total_value").alias("total_cost"),
        exact_mean(F.col("total_value"), 2).cast("decimal(15,2)").alias("mean_cost"),
        exact_mean(F.col("stay_days"), 1).cast("decimal(8,1)").alias("mean_stay"),
        F.sum("death").alias("deaths"),
    )
    return view.orderBy(F.col("year").asc_nulls_last())


def admissions_by_label(grouped: DataFrame) -> DataFrame:
    """Admissions per diagnosis label, from the grouped view; largest first, NULL label in front of ties."""
    return (
        grouped.groupBy("diag_label")
        .agg(F.sum("admissions").alias("total"))
        .orderBy(F.col("total").desc_nulls_first(), F.col("diag_label").asc_nulls_last())
    )


def executive_kpis(projection: DataFrame, spec: ProjectionSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Projection with the frozen and the full scenario in millions."""
    return projection.select(
        *keys,
        "year",
        F.col("admissions_proj").alias("admissions"),
        in_millions(F.col(f"cost_{spec.frozen}")).alias(f"cost_{spec.frozen}_millions"),
        in_millions(F.col(f"cost_{spec.full}")).alias(f"cost_{spec.full}_millions"),
        "rate_per_100k",
        "pop_millions",
        "is_projection",
    ).orderBy(*keys, F.col("year").asc_nulls_last())


def observed_rate(
    clean: DataFrame,
    population: DataFrame,
    keys: Sequence[str] = (),
    *,
    min_age: int | None = 60,
    unit: float = 1e6,
    with_value: bool = False,
) -> DataFrame:
    """Admissions per 100 thousand inhabitants, per key and year; with ``with_value`` also ``base_value``, the mean
    amount per admission, from the same aggregate.

    ``population`` has the keys, ``year`` and ``pop_millions``; ``unit`` is what one of it stands
    for. Admissions are counted before the join, so only one row per key and year meets it. Groups
    without population, also those without a year, have a NULL rate.
    """
    counted = F.lit(True) if min_age is None else F.col("age") >= min_age
    measures = [F.count_if(counted).alias("admissions"), *([_mean_amount()] if with_value else [])]
    admissions = clean.groupBy(*keys, "year").agg(*measures)
    persons = F.col("pop_millions") * F.lit(float(unit))
    rate = half_even(F.try_divide(F.col("admissions").cast("double"), persons) * F.lit(1e5), 2).alias("rate_per_100k")
    joined = admissions.join(population.select(*keys, "year", "pop_millions"), [*keys, "year"], "left")
    return joined.select(*keys, "year", "admissions", "pop_millions", rate, *(["base_value"] if with_value else []))


def base_year_value(clean: DataFrame, base_year: int, keys: Sequence[str] = ()) -> DataFrame:
    """Observed mean amount per admission at the base year, for use as the cost base."""
    at_base = clean.where(F.col("year") == base_year)
    return at_base.groupBy(*keys).agg(_mean_amount()) if keys else at_base.agg(_mean_amount())


def _mean_amount() -> Column:
    return exact_mean(F.col("total_value"), 2).cast("decimal(15,2)").alias("base_value")
