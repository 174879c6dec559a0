"""Which admissions belong to the cohort, and how many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions import code_group, exact_ratio, in_region, starts_with_any
from wardcast.sources.landing import inline_table
from wardcast.sources.tables import asserted_unique
from wardcast.spec import CohortSpec

PRINCIPAL = "DIAG_PRINC"
SECONDARY = "DIAG_SECUN"
RESIDENCE = "MUNIC_RES"


def _require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; check the landing files")


def text(name: str) -> Column:
    """The field as text. On a text column Spark drops the cast, so the reader still sees the bare column."""
    return F.col(name).cast("string")


def code_predicate(raw: DataFrame, spec: CohortSpec, *, secondary: bool = False) -> Column:
    """The principal diagnosis is in the cohort, or with ``secondary`` either diagnosis is."""
    _require(raw, PRINCIPAL, *([SECONDARY] if secondary else []))
    matches = starts_with_any(text(PRINCIPAL), spec.prefixes)
    return matches | starts_with_any(text(SECONDARY), spec.prefixes) if secondary else matches


def region_predicate(raw: DataFrame, spec: CohortSpec) -> Column | None:
    """The residence is in the spec's region; None if there is no region or no residence column."""
    if not spec.region or RESIDENCE not in raw.columns:
        return None
    return in_region(text(RESIDENCE), spec.region, spec.region_digits)


def select_cohort(raw: DataFrame, spec: CohortSpec, *, secondary: bool = False) -> DataFrame:
    """Rows of the cohort. A filter only: no shuffle, and both tests can reach the file reader."""
    cohort = raw.where(code_predicate(raw, spec, secondary=secondary))
    region = region_predicate(raw, spec)
    return cohort if region is None else cohort.where(region)


def cohort_retention(raw: DataFrame, spec: CohortSpec, *, secondary: bool = False) -> DataFrame:
    """One row: rows read, rows with a cohort code, rows also in the region, and the kept percentage.

    The percentage is of all rows read, and 0 if there are none. One pass over two or three columns.
    """
    code = code_predicate(raw, spec, secondary=secondary)
    region = region_predicate(raw, spec)
    counts = raw.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(code).alias("rows_code"),
        F.count_if(code if region is None else code & region).alias("rows_kept"),
    )
    kept = exact_ratio(F.col("rows_kept"), F.col("rows_read"), 3, scale=100)
    return counts.withColumn("kept_pct", F.coalesce(kept, F.lit(0)).cast("decimal(6,3)"))


def label_distribution(
    cohort: DataFrame, spec: CohortSpec, group: Column | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Rows per labelled group, in the order of the labels, 0 for groups without rows.

    Labels are the spec's, or those of a table (``ord``, ``diag_group``, ``diag_label``) with one row per group.
    Groups are counted before they meet the labels.
    """
    group = code_group(text(PRINCIPAL), spec.group_chars) if group is None else group
    if labels is None:
        rows = [(i, code, label) for i, (code, label) in enumerate(spec.labels.items(), start=1)]
        labels = inline_table(cohort.sparkSession, rows, "ord int, diag_group string, diag_label string")
    else:
        labels = asserted_unique(labels.select("ord", "diag_group", "diag_label"), ["diag_group"])
    counts = cohort.groupBy(group.alias("diag_group")).agg(F.count(F.lit(1)).alias("admissions"))
    return (
        labels.join(counts, "diag_group", "left")
        .select("ord", "diag_group", "diag_label", F.coalesce("admissions", F.lit(0)).alias("admissions"))
        .orderBy("ord")
    )


def secondary_uplift(raw: DataFrame, spec: CohortSpec) -> DataFrame:
    """How many admissions the principal diagnosis finds, how many either one finds, and their ratio."""
    principal = code_predicate(raw, spec)
    either = code_predicate(raw, spec, secondary=True)
    region = region_predicate(raw, spec)
    rows = raw if region is None else raw.where(region)
    counts = rows.agg(
        F.count_if(principal).alias("principal"),
        F.count_if(starts_with_any(text(SECONDARY), spec.prefixes)).alias("secondary"),
        F.count_if(either).alias("either"),
    )
    return counts.withColumn("uplift", exact_ratio(F.col("either"), F.col("principal"), 3).cast("decimal(18,3)"))
