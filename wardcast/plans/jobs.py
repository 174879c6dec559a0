"""The batch jobs, in order: cohort, history, projection, rankings, load, dashboard.

Each job reads files or tables and writes files or tables, so a lost executor costs recomputed
tasks only, and a failed job is run again on its own. Files and catalog tables are replaced, so writing
them again changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.operators.cohort import cohort_retention, label_distribution, select_cohort
from wardcast.operators.enrich import enrich
from wardcast.operators.indicators import (
    admissions_by_label,
    observed_rate,
    yearly_history,
)
from wardcast.operators.projection import interpolate_series, project_costs
from wardcast.operators.secondary import secondary_profile
from wardcast.operators.states import admission_states, merged_history, read_states, write_states
from wardcast.operators.territory import facility_totals, territory_table
from wardcast.plans.dashboard import projection_series, secondary_ranking
from wardcast.schemas import COHORT, COHORT_ORDER, COHORT_PARTITIONS, COMORBIDITY, INDICATORS, TABLES, TERRITORY, projection_table
from wardcast.sources import landing, tables
from wardcast.spec import CohortSpec, ProjectionSpec, TerritorySpec

def read_landing(
    spark: SparkSession,
    path: str,
    states: Sequence[str] = (),
    years: Sequence[int] = (),
    months: Sequence[int] = (),
    file_format: str = "parquet",
    ledger: str | None = None,
) -> DataFrame:
    raw = landing.read_admissions(spark, path, states=states, years=years, months=months, file_format=file_format, ledger=ledger)
    return landing.require_rows(raw, f"landing selection in {path}").withColumnsRenamed(
        {"year": "file_year", "month": "file_month"}
    )


def build_cohort(raw: DataFrame, out: str, spec: CohortSpec, *, secondary: bool = False) -> DataFrame:
    """Select, clean and write the cohort; returns the written table.

    The code and region tests come first, so only cohort rows are parsed and shuffled to the writers.
    """
    clean = enrich(select_cohort(raw, spec, secondary=secondary), spec, carry=COHORT_PARTITIONS)
    tables.write_parquet(clean, out, COHORT_PARTITIONS, COHORT_ORDER)
    return read_cohort(raw.sparkSession, out)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_parquet(spark, path, COHORT)


def cohort_report(raw: DataFrame, written: DataFrame, spec: CohortSpec, *, secondary: bool = False) -> tuple[DataFrame, DataFrame]:
    """Retention counts of the landing rows, and the label distribution of the cohort as it was written. Counted from the
    data rather than from task metrics, which a recomputed task would count twice."""
    return cohort_retention(raw, spec, secondary=secondary), label_distribution(written, spec, F.col("diag_group"))


def build_states(
    spark: SparkSession, cohort_path: str, out: str, states: Sequence[str] = (), years: Sequence[int] = (), months: Sequence[int] = ()
) -> DataFrame:
    """The partial states of the cohort's landing files, all or those of the selection, in place of their earlier ones."""
    clean = read_cohort(spark, cohort_path)
    for name, wanted in zip(COHORT_PARTITIONS, (states, years, months), strict=True):
        if wanted:
            clean = clean.where(F.col(name).isin(*wanted))
    write_states(admission_states(clean), out)
    return read_states(spark, out)


def build_history(spark: SparkSession, cohort_path: str, out: str, states_path: str | None = None) -> DataFrame | None:
    """Yearly indicators of the written cohort, or None if it has not been built. With the states of its landing files,
    those are merged and the cohort is not read."""
    if states_path:
        history = merged_history(read_states(spark, states_path))
    else:
        clean = landing.read_optional(spark, cohort_path, COHORT)
        if clean is None:
            return None
        history = yearly_history(clean)
    tables.write_csv(tables.conform(history, INDICATORS), out)
    return tables.read_csv(spark, out, INDICATORS)


def build_projection(
    anchors: DataFrame, out: str, spec: ProjectionSpec, keys: Sequence[str] = (), cohort: DataFrame | None = None
) -> DataFrame:
    """Project population anchors and write the table.

    With a cohort (which then has the keys as columns) the rate and the cost per admission are those
    observed at the base year; where nothing was observed the spec's apply.
    """
    anchors = tables.asserted_unique(anchors, [*keys, "year"])
    rates = base_values = None
    if cohort is not None:
        observed = observed_rate(cohort, interpolate_series(anchors, keys), keys, with_value=True)
        at_base = observed.where(F.col("year") == spec.base_year)
        rates = at_base.select(*keys, F.col("rate_per_100k").alias("rate"))
        base_values = at_base.select(*keys, "base_value")
    projection = project_costs(anchors, spec, keys, rates=rates, base_values=base_values)
    schema = projection_table(keys).schema
    tables.write_csv(tables.conform(projection, schema), out)
    return tables.read_csv(anchors.sparkSession, out, schema)


def build_rankings(
    raw: DataFrame,
    cohort: DataFrame,
    projection: DataFrame,
    names: DataFrame,
    out_territory: str,
    out_comorbidity: str,
    cohort_spec: CohortSpec,
    projection_spec: ProjectionSpec,
    territory_spec: TerritorySpec,
    descriptions: Mapping[str, str] | DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Territory ranking per state and the conditions seen with a secondary cohort diagnosis.

    ``projection`` is keyed by ``region`` (the state), ``names`` has (region, name).
    """
    spark = raw.sparkSession
    ranked = territory_table(
        facility_totals(cohort.withColumnRenamed("state", "region"), ["region"]), projection, names, territory_spec, projection_spec.base_year
    )
    tables.write_csv(tables.conform(ranked, TERRITORY), out_territory)
    tables.write_csv(tables.conform(secondary_profile(raw, cohort_spec, descriptions), COMORBIDITY), out_comorbidity)
    return tables.read_csv(spark, out_territory, TERRITORY), tables.read_csv(spark, out_comorbidity, COMORBIDITY)


def projection_keys(columns: Sequence[str]) -> list[str]:
    """What a projection with these columns is split by."""
    return [c for c in ("region",) if c in columns]


def load_tables(frames: Mapping[str, DataFrame | None], prefix: str = "") -> dict[str, int]:
    """Load what there is into the typed tables and return the rows loaded. A projection per region has the region in
    its key."""
    known = dict(TABLES)
    if frames.get("projection") is not None:
        known["projection"] = projection_table(projection_keys(frames["projection"].columns))
    return {n: tables.load_table(df, prefix + n, known[n]) for n, df in frames.items() if df is not None}


def create_views(spark: SparkSession, spec: ProjectionSpec, prefix: str = "") -> None:
    """The grouped-admissions and executive-KPI views over the loaded tables, kept in the catalog beside them.

    They are stored as SQL; their columns are those of ``grouped_admissions`` and ``executive_kpis``.
    """
    keys = projection_keys(spark.table(prefix + "projection").columns)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {prefix}grouped_admissions AS
        SELECT year, diag_group, diag_label, age_band, count(*) AS admissions, sum(total_value) AS total_cost,
            CAST(round(try_divide(sum(total_value), count(total_value)), 2) AS decimal(15,2)) AS mean_cost,
            CAST(round(try_divide(CAST(sum(stay_days) AS decimal(20,0)), count(stay_days)), 1) AS decimal(8,1)) AS mean_stay,
            sum(death) AS deaths
        FROM {prefix}admissions GROUP BY year, diag_group, diag_label, age_band
    """)
    shown = [f"round(cost_{name} / 1000000, 2) AS cost_{name}_millions" for name in (spec.frozen, spec.full)]
    spark.sql(f"""
        CREATE OR REPLACE VIEW {prefix}executive_kpis AS
        SELECT {", ".join([*keys, "year", "admissions_proj AS admissions", *shown])}, rate_per_100k, pop_millions, is_projection
        FROM {prefix}projection
    """)


def dashboard_frames(spark: SparkSession, spec: ProjectionSpec, prefix: str = "") -> dict[str, DataFrame]:
    """The dashboard's four result sets from the loaded tables and views."""
    territory, projection = spark.table(prefix + "territory"), spark.table(prefix + "projection")
    return {
        "projection": projection_series(projection, spec, projection_keys(projection.columns)),
        "territory": territory.orderBy(F.col("score").desc_nulls_first(), "region"),
        "comorbidity": secondary_ranking(
            spark.table(prefix + "comorbidity").select("code", "description", "admissions")
        ),
        "labels": admissions_by_label(spark.table(prefix + "grouped_admissions")),
    }
