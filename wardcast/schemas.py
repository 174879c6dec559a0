"""Table schemas. Field comments travel with the data as column metadata and become
column comments when a table is saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T


def _field(name: str, dtype: T.DataType, comment: str | None = None, length: int | None = None) -> T.StructField:
    metadata: dict[str, object] = {}
    if comment:
        metadata["comment"] = comment
    if length:
        metadata["max_length"] = length
    return T.StructField(name, dtype, True, metadata)


# Field names of the landing files, with the names used here.
RAW_TO_CLEAN = {
    "DIAG_PRINC": "diag_code",
    "DIAG_SECUN": "diag_secondary",
    "MUNIC_RES": "residence_code",
    "IDADE": "age",
    "SEXO": "sex_code",
    "DIAS_PERM": "stay_days",
    "VAL_TOT": "total_value",
    "MORTE": "death",
    "ANO_CMPT": "year",
    "MES_CMPT": "month",
    "CNES": "facility_id",
}

# Landing files are text in every field, so that one bad value never fails a scan.
RAW = T.StructType([T.StructField(name, T.StringType()) for name in RAW_TO_CLEAN])

LANDING_PARTITIONS = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

CLEAN = T.StructType(
    [
        _field("diag_code", T.StringType(), "Code the stay is billed under.", 10),
        _field("diag_secondary", T.StringType(), "Further code of the stay, if any.", 10),
        _field("diag_group", T.StringType(), "Leading characters of diag_code in upper case; the key of its label.", 5),
        _field("diag_label", T.StringType(), "Name of diag_group, NULL where the labels have none.", 60),
        _field("residence_code", T.StringType(), "Where the patient lives, six or seven digits.", 10),
        _field("year", T.IntegerType(), "Billing year in the row, NULL if it is no whole number."),
        _field("month", T.IntegerType(), "Billing month in the row, NULL if it is no whole number."),
        _field("stay_days", T.IntegerType(), "Length of the stay, rounded to days."),
        _field("total_value", T.DecimalType(15, 2), "What was paid for the stay, with cents."),
        _field("age", T.IntegerType(), "Age rounded to years."),
        _field("age_band", T.StringType(), "Label of the age band, taken from the unrounded age.", 10),
        _field("sex_code", T.StringType(), "Sex as the landing file writes it.", 3),
        _field("sex_label", T.StringType(), "Name of sex_code, NULL where the labels have none.", 12),
        _field("facility_id", T.StringType(), "Registry number of the facility.", 10),
        _field("death", T.IntegerType(), "1 where the stay ended in death."),
    ]
)

# A clean admission is stored by the landing file that it came from, whatever dates the row carries.
COHORT_PARTITIONS = ("state", "file_year", "file_month")
# Cohorts are read by code prefix.
COHORT_ORDER = ("diag_code",)
COHORT = T.StructType(
    [
        *CLEAN.fields,
        _field("state", T.StringType(), "State of the landing file."),
        _field("file_year", T.IntegerType(), "Year of the landing file."),
        _field("file_month", T.IntegerType(), "Month of the landing file."),
    ]
)

INDICATORS = T.StructType(
    [
        _field("year", T.IntegerType(), "Year."),
        _field("admissions", T.LongType(), "Rows with a principal diagnosis."),
        _field("mean_value", T.DecimalType(15, 2), "Sum of total_value over the rows that have one."),
        _field("mean_stay", T.DecimalType(8, 2), "Sum of stay_days over the rows that have one."),
    ]
)

PROJECTION = T.StructType(
    [
        _field("year", T.IntegerType(), "Year."),
        _field("pop_millions", T.DecimalType(8, 2), "Interpolated population of the anchors, in millions."),
        _field("rate_per_100k", T.DecimalType(8, 2), "Rate applied to pop_millions, per 100 thousand."),
        _field("admissions_proj", T.LongType(), "pop_millions times the rate, as a whole number."),
        _field("cost_a", T.DecimalType(18, 2), "admissions_proj at the base price."),
        _field("cost_b", T.DecimalType(18, 2), "admissions_proj at a price that grows by the middle rate after the base year."),
        _field("cost_c", T.DecimalType(18, 2), "admissions_proj at a price that grows by the highest rate after the base year."),
        _field("is_projection", T.IntegerType(), "1 after the base year, else 0."),
    ]
)

TERRITORY = T.StructType(
    [
        _field("region", T.StringType(), "Key of the region.", 10),
        _field("name", T.StringType(), "Name shown for the region.", 40),
        _field("growth_pct", T.DecimalType(5, 1), "Last over first projected admissions, less 1, in percent."),
        _field("score", T.IntegerType(), "Geometric mean of six totals, 100 for the highest region."),
        _field("level", T.StringType(), "Name of the band that score falls into.", 15),
    ]
)

COMORBIDITY = T.StructType(
    [
        _field("code", T.StringType(), "diag_group of rows whose further code is in the cohort.", 10),
        _field("description", T.StringType(), "Name of the code, NULL without one.", 60),
        _field("admissions", T.LongType(), "Number of such rows."),
    ]
)

ANCHORS = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("pop_millions", T.DoubleType())])


class TableDef:
    """A persisted table: schema, description, the columns that must be unique, and how its files are split and sorted."""

    def __init__(
        self,
        schema: T.StructType,
        comment: str,
        key: tuple[str, ...] = (),
        partition_by: tuple[str, ...] = (),
        sort_by: tuple[str, ...] = (),
    ):
        self.schema = schema
        self.sort_by = sort_by
        self.comment = comment
        self.key = key
        self.partition_by = partition_by


def projection_table(keys: Sequence[str] = ()) -> TableDef:
    """The projection with one row for each year, or for each value of the keys and year."""
    schema = T.StructType([_field(k, T.StringType(), "What the projection is split by.") for k in keys] + PROJECTION.fields)
    return TableDef(schema, "One row per projected year: population, admissions and their cost in each scenario.", (*keys, "year"))


TABLES = {
    "admissions": TableDef(COHORT, "Clean rows of the cohort, by the landing file they came from.", partition_by=COHORT_PARTITIONS, sort_by=COHORT_ORDER),
    "indicators": TableDef(INDICATORS, "Counts and means of the cohort for each billing year.", key=("year",)),
    "projection": projection_table(),
    "territory": TableDef(TERRITORY, "Regions with their score, its level and their projected growth.", key=("region",)),
    "comorbidity": TableDef(COMORBIDITY, "What patients with a further code of the cohort are in hospital for.", key=("code",)),
}
