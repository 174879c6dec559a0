"""Sparse population series to yearly projections with cost scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions import compound, exact_ratio, half_even
from wardcast.sources.tables import asserted_unique
from wardcast.spec import ProjectionSpec


def interpolate_series(
    anchors: DataFrame,
    keys: Sequence[str] = (),
    *,
    year: str = "year",
    value: str = "pop_millions",
    digits: int = 2,
) -> DataFrame:
    """Every year from the first to the last anchor of a key, linear in between, rounded half to even.

    ``anchors`` has one row per key and year, so a window partition holds no more rows than there
    are years, also without keys.
    """
    by_key = Window.partitionBy(*keys).orderBy(year)
    y, v = F.col(year), F.col(value).cast("double")
    segments = anchors.select(
        *keys,
        y.alias("_y0"),
        v.alias("_v0"),
        F.lead(y).over(by_key).alias("_y1"),
        F.lead(v).over(by_key).alias("_v1"),
    )
    last = F.coalesce(F.col("_y1") - 1, F.col("_y0"))
    dense = segments.withColumn(year, F.explode(F.sequence("_y0", last)))
    slope = (F.col("_v1") - F.col("_v0")) / (F.col("_y1") - F.col("_y0"))
    line = slope * (F.col(year) - F.col("_y0")) + F.col("_v0")
    point = F.when(F.col(year) == F.col("_y0"), F.col("_v0")).otherwise(line)
    return dense.select(*keys, year, half_even(point, digits).alias(value))


def project(
    population: DataFrame,
    spec: ProjectionSpec,
    keys: Sequence[str] = (),
    rates: DataFrame | None = None,
) -> DataFrame:
    """Admissions = rounded population in 100 thousands x rate, and the projected-year flag.

    The rate is the spec's, or that of the ``rates`` table (keys, ``rate``) where it has one.
    """
    rate = F.lit(float(spec.rate))
    if rates is not None:
        population = _attach(population, rates, "rate", keys)
        rate = F.coalesce(F.col("rate").cast("double"), rate)
    admissions = half_even(F.col("pop_millions") * F.lit(1e6) / F.lit(1e5) * rate, 0)
    return population.select(
        *keys,
        "year",
        "pop_millions",
        half_even(rate, 2).alias("rate_per_100k"),
        admissions.cast("long").alias("admissions_proj"),
        (F.col("year") > spec.base_year).cast("int").alias("is_projection"),
    )


def scenario_costs(
    projection: DataFrame,
    spec: ProjectionSpec,
    keys: Sequence[str] = (),
    *,
    base_values: DataFrame | None = None,
    wide: bool = True,
) -> DataFrame:
    """Cost of the projected admissions under each scenario: one column per scenario, or one row.

    The scenarios are literals of the plan, so neither form needs a join. ``base_values`` (keys,
    ``base_value``) replaces the spec's cost per admission where it has a value.
    """
    base: Column = F.lit(float(spec.base_value))
    if base_values is not None:
        projection = _attach(projection, base_values, "base_value", keys)
        base = F.coalesce(F.col("base_value").cast("double"), base)
    ahead = F.greatest(F.col("year") - F.lit(spec.base_year), F.lit(0))

    def cost(rate: Column) -> Column:
        return half_even(F.col("admissions_proj") * compound(base, rate, ahead), 2).cast("decimal(18,2)")

    head = [*keys, "year", "pop_millions", "rate_per_100k", "admissions_proj"]
    if wide:
        costs = [cost(F.lit(float(r))).alias(f"cost_{name}") for name, r in spec.scenarios.items()]
        return projection.select(*head, *costs, "is_projection")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), F.lit(float(r)).alias("annual_rate"))
            for name, r in spec.scenarios.items()
        ]
    )
    every = projection.withColumn("_s", F.explode(rows))
    return every.select(
        *head,
        "is_projection",
        F.col("_s.scenario").alias("scenario"),
        F.col("_s.annual_rate").alias("annual_rate"),
        cost(F.col("_s.annual_rate")).alias("cost"),
    )


def project_costs(
    anchors: DataFrame,
    spec: ProjectionSpec,
    keys: Sequence[str] = (),
    *,
    rates: DataFrame | None = None,
    base_values: DataFrame | None = None,
) -> DataFrame:
    """From population anchors to the yearly projection table with one cost column per scenario."""
    population = interpolate_series(anchors, keys)
    return scenario_costs(project(population, spec, keys, rates), spec, keys, base_values=base_values)


def milestones(projection: DataFrame, years: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Population and admissions of selected years."""
    return (
        projection.where(F.col("year").isin(*years))
        .select(*keys, "year", "pop_millions", "admissions_proj")
        .orderBy(*keys, "year")
    )


def linear_trend(df: DataFrame, x: str = "year", y: str = "admissions_proj", keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and fit of ``y`` on ``x``, per key."""
    by = F.col(y).cast("double"), F.col(x).cast("double")
    measures = [
        F.round(F.regr_slope(*by), 6).alias("slope"),
        F.round(F.regr_intercept(*by), 3).alias("intercept"),
        F.round(F.regr_r2(*by), 6).alias("r2"),
    ]
    return df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)


def endpoint_growth(
    df: DataFrame, x: str = "year", y: str = "admissions_proj", keys: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """First and last value along ``x`` and the growth between them in percent, per key."""
    measures = [
        F.min(x).alias("first_year"),
        F.max(x).alias("last_year"),
        F.min_by(y, x).alias("first_value"),
        F.max_by(y, x).alias("last_value"),
    ]
    ends = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    grown = F.col("last_value") - F.col("first_value")
    if isinstance(df.schema[y].dataType, T.IntegralType):
        growth = exact_ratio(grown, F.col("first_value"), digits, scale=100)
    else:
        growth = F.round(F.try_divide(grown, F.col("first_value")) * 100, digits)
    return ends.withColumn("growth_pct", growth.cast(f"decimal(18,{digits})"))


def _attach(df: DataFrame, values: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Add one column from a table with a row per key, which the plan asserts; without keys the table is a single value."""
    if keys:
        return df.join(asserted_unique(values.select(*keys, name), keys), list(keys), "left")
    return df.withColumn(name, values.select(name).scalar())
