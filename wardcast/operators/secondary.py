"""What patients are admitted for when the cohort code is only the secondary diagnosis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions import code_group, lookup, starts_with_any
from wardcast.operators.cohort import PRINCIPAL, SECONDARY, region_predicate, text
from wardcast.operators.enrich import attach_label
from wardcast.spec import CohortSpec


def secondary_profile(
    raw: DataFrame, spec: CohortSpec, descriptions: Mapping[str, str] | DataFrame | None = None
) -> DataFrame:
    """Admissions per principal diagnosis group where the secondary diagnosis is in the cohort.

    Descriptions come from a small dictionary, or from a table (``code``, ``description``) joined
    after the count.
    """
    rows = raw.where(starts_with_any(text(SECONDARY), spec.prefixes))
    region = region_predicate(raw, spec)
    if region is not None:
        rows = rows.where(region)
    counts = rows.groupBy(code_group(text(PRINCIPAL), spec.group_chars).alias("code")).agg(
        F.count(F.lit(1)).alias("admissions")
    )
    if isinstance(descriptions, DataFrame):
        named = attach_label(counts, descriptions, "code", "description")
    else:
        named = counts.withColumn("description", lookup(F.col("code"), descriptions or {}))
    return named.select("code", "description", "admissions").orderBy(*most_admissions())


def most_admissions() -> tuple[Column, Column]:
    """Sort order of the ranking: most admissions first, then by code."""
    return F.col("admissions").desc_nulls_first(), F.col("code").asc_nulls_last()
