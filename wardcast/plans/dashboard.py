"""Result sets of the dashboard, and the questions users ask of the projection and the rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions import (
    code_with_description,
    decimal_comma,
    dotted_thousands,
    exact_ratio,
    in_millions,
    signed_percent,
)
from wardcast.operators.secondary import most_admissions
from wardcast.operators.territory import level_tier, with_rank
from wardcast.spec import ProjectionSpec, TerritorySpec


def projection_series(projection: DataFrame, spec: ProjectionSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Chart series: population, admissions, and the frozen and full cost, also in millions."""
    frozen, full = f"cost_{spec.frozen}", f"cost_{spec.full}"
    return projection.select(
        *keys,
        "year",
        "pop_millions",
        "admissions_proj",
        frozen,
        full,
        in_millions(F.col(frozen), 1).alias(f"{frozen}_chart"),
        in_millions(F.col(full), 1).alias(f"{full}_chart"),
        "is_projection",
    ).orderBy(*keys, F.col("year").asc_nulls_last())


def territory_ranking(territory: DataFrame, spec: TerritorySpec, key: str = "region") -> DataFrame:
    """Regions by score, with rank, display tier and bar width."""
    ranked = with_rank(territory)
    return ranked.select(
        key,
        "name",
        "growth_pct",
        "score",
        "level",
        "rank",
        level_tier(F.col("level"), spec).alias("tier"),
        F.least(F.lit(100), F.col("score")).alias("bar_width"),
    ).orderBy(F.col("score").desc_nulls_first(), key)


def top_territories(territory: DataFrame, k: int = 3, key: str = "region") -> DataFrame:
    """The k regions with the highest score. A top-k, so no full sort."""
    return (
        territory.select(key, "name", "score", "raw_score", "level")
        .orderBy(F.col("score").desc_nulls_first(), F.col("raw_score").desc_nulls_first(), key)
        .limit(k)
    )


def secondary_ranking(profile: DataFrame) -> DataFrame:
    """Conditions by admissions, with the chart label."""
    return profile.select(
        "code",
        "description",
        "admissions",
        code_with_description(F.col("code"), F.col("description")).alias("chart_label"),
    ).orderBy(*most_admissions())


def top_conditions(profile: DataFrame, k: int = 5) -> DataFrame:
    """The k conditions that appear most."""
    return profile.orderBy(*most_admissions()).limit(k)


def headline_kpis(projection: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last admissions, growth, last population and rate, as numbers and as shown."""
    measures = [
        F.min_by("admissions_proj", "year").alias("_first"),
        F.max_by("admissions_proj", "year").alias("last_admissions"),
        F.max_by("pop_millions", "year").alias("last_pop_millions"),
        F.max_by("rate_per_100k", "year").alias("rate_per_100k"),
    ]
    ends = projection.groupBy(*keys).agg(*measures) if keys else projection.agg(*measures)
    growth = exact_ratio(F.col("last_admissions") - F.col("_first"), F.col("_first"), 3, scale=100)
    ends = ends.withColumn("growth_pct", growth.cast("decimal(18,3)"))
    return ends.select(
        *keys,
        "last_admissions",
        "growth_pct",
        "last_pop_millions",
        "rate_per_100k",
        dotted_thousands(F.col("last_admissions")).alias("admissions_text"),
        signed_percent(F.col("growth_pct")).alias("growth_text"),
        decimal_comma(F.col("last_pop_millions")).alias("pop_text"),
        decimal_comma(F.col("rate_per_100k")).alias("rate_text"),
    )


def compare_years(projection: DataFrame, first: int, last: int, keys: Sequence[str] = ()) -> DataFrame:
    """Admissions of two years side by side, in one pass, with difference and growth."""

    def at(year: int) -> Column:
        return F.max(F.when(F.col("year") == year, F.col("admissions_proj")))

    measures = [at(first).alias("first_admissions"), at(last).alias("last_admissions")]
    rows = projection.where(F.col("year").isin(first, last))
    both = rows.groupBy(*keys).agg(*measures) if keys else rows.agg(*measures)
    added = F.col("last_admissions") - F.col("first_admissions")
    return both.withColumn("added", added).withColumn(
        "growth_pct", exact_ratio(added, F.col("first_admissions"), 3, scale=100).cast("decimal(18,3)")
    )


def scenario_gap(costs: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """Total cost in the final year, frozen against full adjustment, from the long scenario table."""

    def cost(name: str) -> Column:
        return F.sum(F.when(F.col("scenario") == name, F.col("cost")))

    last = costs.where(F.col("year") == spec.end_year)
    totals = last.agg(cost(spec.frozen).alias("frozen_cost"), cost(spec.full).alias("full_cost"))
    ratio = F.try_divide(F.col("full_cost").cast("double"), F.col("frozen_cost").cast("double"))
    return totals.select(
        F.lit(spec.end_year).alias("year"),
        "frozen_cost",
        "full_cost",
        (F.col("full_cost") - F.col("frozen_cost")).alias("gap"),
        F.round(ratio, 6).alias("ratio"),
    )


def ageing_summary(projection: DataFrame, spec: ProjectionSpec) -> DataFrame:
    """One row: growth of admissions to the final year, yearly trend, and final cost by scenario."""
    frozen, full = f"cost_{spec.frozen}", f"cost_{spec.full}"
    last_costs = projection.agg(
        F.max_by("pop_millions", "year").alias("last_pop_millions"),
        F.max_by(frozen, "year").alias("frozen_cost"),
        F.max_by(full, "year").alias("full_cost"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min_by("admissions_proj", "year").alias("first_value"),
        F.max_by("admissions_proj", "year").alias("last_value"),
        F.round(F.regr_slope(F.col("admissions_proj").cast("double"), F.col("year").cast("double")), 6).alias("slope"),
    )
    grown = exact_ratio(F.col("last_value") - F.col("first_value"), F.col("first_value"), 3, scale=100)
    return last_costs.withColumn("growth_pct", grown.cast("decimal(18,3)")).withColumn(
        "gap", F.col("full_cost") - F.col("frozen_cost")
    )
