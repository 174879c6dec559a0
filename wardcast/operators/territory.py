"""Risk ranking of regions.

The score is this library's definition: the geometric mean of six totals per region (admissions,
population, days of stay, amount paid, deaths, facilities), scaled so that the highest region has
100. A region where one of them is zero or unknown scores 0. It orders regions as their product does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardcast.functions import exact_ratio
from wardcast.operators.enrich import attach_label
from wardcast.spec import TerritorySpec

MEASURES = ("admissions", "population", "stay_days", "total_value", "deaths", "facilities")


def facility_totals(clean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Admissions, days of stay, amount and deaths per facility (and key), with partial sums in each task."""
    return clean.groupBy(*keys, "facility_id").agg(
        F.count(F.lit(1)).alias("admissions"),
        F.sum("stay_days").alias("stay_days"),
        F.sum("total_value").alias("total_value"),
        F.sum("death").alias("deaths"),
    )


def region_totals(facilities: DataFrame, key: str) -> DataFrame:
    """Five of the six totals per region, from ``facility_totals`` with the region of each facility; the population
    comes from the projection. Rows without a facility count, but as none."""
    return facilities.groupBy(key).agg(
        F.sum("admissions").alias("admissions"),
        F.sum("stay_days").alias("stay_days"),
        F.sum("total_value").alias("total_value"),
        F.sum("deaths").alias("deaths"),
        F.count("facility_id").alias("facilities"),
    )


def region_outlook(projection: DataFrame, key: str, base_year: int) -> DataFrame:
    """Population at the base year and projected growth of admissions in percent, per region."""
    first, last = F.min_by("admissions_proj", "year"), F.max_by("admissions_proj", "year")
    return projection.groupBy(key).agg(
        F.max(F.when(F.col("year") == base_year, F.col("pop_millions"))).alias("population"),
        exact_ratio(last - first, first, 1, scale=100).cast("decimal(18,1)").alias("growth_pct"),
    )


def territory_score(measures: DataFrame, spec: TerritorySpec) -> DataFrame:
    """Adds ``raw_score`` (six decimals), ``score`` (whole) and ``level``.

    The best region's value is a one-row aggregate of the same region table, which Spark reuses.
    """
    logs = [F.ln(F.col(m).cast("double")) for m in MEASURES]
    positive = reduce(lambda a, b: a & b, [F.col(m) > 0 for m in MEASURES])
    logged = measures.withColumn("_mean_ln", F.when(positive, reduce(add, logs) / F.lit(float(len(MEASURES)))))
    best = logged.agg(F.max("_mean_ln")).scalar()
    raw = F.coalesce(F.lit(100.0) * F.exp(F.col("_mean_ln") - best), F.lit(0.0))
    scored = logged.withColumn("raw_score", F.round(raw, 6)).drop("_mean_ln")
    scored = scored.withColumn("score", F.round("raw_score", 0).cast("int"))
    return scored.withColumn("level", score_level(F.col("score"), spec))


def score_level(score: Column, spec: TerritorySpec) -> Column:
    level = F.when(score.isNull(), F.lit(None).cast("string"))
    for cut, name in spec.levels:
        level = level.when(score >= cut, F.lit(name))
    return level.otherwise(F.lit(spec.floor_level))


def level_tier(level: Column, spec: TerritorySpec) -> Column:
    """Display tier 1 to 3 of a level name; names beginning like a tier-two level count as that."""
    second = reduce(lambda a, b: a | b, [level.startswith(name) for name in spec.tier_two])
    return F.when(level.isin(*spec.tier_one), F.lit(1)).when(second, F.lit(2)).otherwise(F.lit(3))


def with_rank(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` by descending score.

    Whole scores take at most 101 values. Ranks are found on the counts per score and joined back,
    so the region table itself never goes through a single task.
    """
    per_score = scored.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_score.select("score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return scored.join(F.broadcast(ranks), "score", "left").select(*scored.columns, "rank")


def territory_table(
    facilities: DataFrame,
    projection: DataFrame,
    names: DataFrame,
    spec: TerritorySpec,
    base_year: int,
    key: str = "region",
) -> DataFrame:
    """Region, name, projected growth, score and level, with the measures behind the score.

    ``facilities`` has the totals of each facility and its region.
    """
    measures = region_totals(facilities, key).join(region_outlook(projection, key, base_year), key, "left")
    named = attach_label(territory_score(measures, spec), names, key, "name")
    return named.select(key, "name", "growth_pct", *MEASURES, "raw_score", "score", "level")
