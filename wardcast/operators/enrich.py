"""From landing fields to the clean, typed and labelled admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions import (
    code_group,
    lookup,
    parse_decimal,
    parse_double,
    parse_int,
    parse_whole,
    right_closed_band,
)
from wardcast.schemas import CLEAN, RAW_TO_CLEAN
from wardcast.sources.tables import asserted_unique
from wardcast.spec import CohortSpec


def enrich(cohort: DataFrame, spec: CohortSpec, *, carry: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """Clean columns for whichever landing fields exist, plus the ``carry`` columns unchanged.

    Two projections and nothing else: fields are read once in the first, and labels and bands, which
    look at a value several times, are taken from the typed columns in the second. Labels come from
    the spec's dictionaries, so nothing is joined or shuffled, or those of the diagnosis from a table
    ``labels`` (``diag_group``, ``diag_label``), which is joined and must have one row per group.
    """
    kinds = {f.name: f.dataType for f in cohort.schema.fields}
    typed = {
        name: READERS.get(name, _text)(F.col(field), kinds[field])
        for field, name in RAW_TO_CLEAN.items()
        if field in kinds
    }
    derived: dict[str, Column] = {}
    if "diag_code" in typed:
        typed["diag_group"] = code_group(F.col("DIAG_PRINC"), spec.group_chars)
        if labels is None:
            derived["diag_label"] = lookup(F.col("diag_group"), spec.labels)
    if "sex_code" in typed:
        derived["sex_label"] = lookup(F.col("sex_code"), spec.sex_labels)
    if "age" in typed:
        # The band is taken from the unrounded age: 59.5 is above 59.
        typed["age"] = parse_double(F.col("IDADE"), kinds["IDADE"])
        derived["age_band"] = right_closed_band(F.col("age"), spec.age_edges, spec.age_labels)
        derived["age"] = F.round("age", 0).try_cast("int")

    once = cohort.select(*[c.alias(name) for name, c in typed.items()], *carry)
    if labels is not None and "diag_group" in typed:
        once = attach_label(once, labels, "diag_group", "diag_label")
        typed["diag_label"] = F.col("diag_label")
    ordered = [name for name in CLEAN.fieldNames() if name in typed or name in derived]
    return once.select(*[derived[n].alias(n) if n in derived else F.col(n) for n in ordered], *carry)


def _text(value: Column, _: T.DataType) -> Column:
    return value.cast("string")


READERS = {
    "year": parse_whole,
    "month": parse_whole,
    "stay_days": parse_int,
    "total_value": parse_decimal,
    "death": parse_int,
}


def attach_label(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Add a label from a dimension table; NULL where it has none. A key that the dimension repeats fails the job,
    as it would multiply rows.

    There is no broadcast hint: Spark broadcasts
    the dimension if it is small, and splits hot keys of a shuffled join at run time. Count before
    labelling where the label is only shown with totals.
    """
    return df.join(asserted_unique(labels.select(key, label), [key]), key, "left")


def rename_fields(df: DataFrame) -> DataFrame:
    """Landing fields under their final names, keeping only those that exist."""
    return df.select(*[F.col(old).alias(new) for old, new in RAW_TO_CLEAN.items() if old in df.columns])


def cast_quality(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: rows, missing, unreadable as a number, and fractional. One pass, one row per field."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts: list[Column] = []
    for name in fields:
        value = F.col(name)
        number = parse_double(value, kinds[name])
        counts.append(
            F.struct(
                F.lit(name).alias("field"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(value.isNull()).alias("missing"),
                F.count_if(value.isNotNull() & number.isNull()).alias("unreadable"),
                F.count_if(number != F.floor(number)).alias("fractional"),
            )
        )
    return df.agg(F.array(*counts).alias("report")).select(F.inline("report"))
