"""Every operator as a named query over the given star-schema tables.

Each query reads whole tables. Decimals are shown as doubles so that the results compare with
another engine's regardless of its decimal widths.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions import code_group, parse_decimal, parse_int, parse_whole
from wardcast.operators import cohort, enrich, indicators, projection, secondary, states, territory
from wardcast.plans import dashboard
from wardcast.schemas import CLEAN, COHORT, COHORT_PARTITIONS, INDICATORS, TABLES, TableDef, projection_table
from wardcast.sources import landing, star, storage, tables
from wardcast.sources.star import (
    DESCRIPTIONS,
    STAR_CITY_COHORT,
    STAR_COHORT,
    STAR_PROJECTION,
    STAR_TERRITORY,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REGION = ["region"]
ALL_FIELDS = [
    "DIAG_PRINC",
    "DIAG_SECUN",
    "MUNIC_RES",
    "IDADE",
    "SEXO",
    "DIAS_PERM",
    "VAL_TOT",
    "MORTE",
    "ANO_CMPT",
    "MES_CMPT",
    "CNES",
]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: _plain(build(spark, sf_dir))
    return build


def _plain(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _clean(
    spark: SparkSession, sf_dir: str, fields: list[str], carry: tuple[str, ...] = (), text: bool = False
) -> DataFrame:
    raw = star.admissions(spark, sf_dir, [*fields, *carry], text=text)
    return enrich.enrich(cohort.select_cohort(raw, STAR_COHORT), STAR_COHORT, carry=carry)


def _projection(spark: SparkSession, sf_dir: str, keys: list[str] = REGION) -> DataFrame:
    anchors = star.population_anchors(spark, sf_dir, keys)
    return projection.project_costs(anchors, STAR_PROJECTION, keys)


# --- cohort -------------------------------------------------------------------------------------


@query
def cohort_filter(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "MUNIC_RES", "ANO_CMPT", "VAL_TOT"], text=True)
    kept = cohort.select_cohort(raw, STAR_COHORT)
    return kept.withColumn("diag_group", code_group(F.col("DIAG_PRINC")))


@query
def cohort_region_filter(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "MUNIC_RES", "ANO_CMPT", "VAL_TOT"], text=True)
    return cohort.select_cohort(raw, STAR_CITY_COHORT)


@query
def cohort_retention(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "MUNIC_RES"])
    return cohort.cohort_retention(raw, STAR_CITY_COHORT)


@query
def label_distribution(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC"])
    return cohort.label_distribution(cohort.select_cohort(raw, STAR_COHORT), STAR_COHORT)


@query
def either_diagnosis_cohort(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "DIAG_SECUN", "ANO_CMPT"], text=True)
    kept = cohort.select_cohort(raw, STAR_COHORT, secondary=True)
    return kept.groupBy("ANO_CMPT", "DIAG_PRINC").agg(F.count(F.lit(1)).alias("admissions"))


@query
def either_diagnosis_uplift(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "DIAG_SECUN", "MUNIC_RES"])
    return cohort.secondary_uplift(raw, STAR_CITY_COHORT)


# --- clean and enrich ---------------------------------------------------------------------------


@query
def enriched_admissions(spark, sf_dir):
    return _clean(spark, sf_dir, ALL_FIELDS, carry=("region",), text=True)


@query
def renamed_fields(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "SEXO", "CNES", "region"], text=True)
    renamed = enrich.rename_fields(raw)
    return renamed.groupBy("diag_code", "sex_code").agg(
        F.count(F.lit(1)).alias("admissions"), F.count_distinct("facility_id").alias("facilities")
    )


@query
def age_band_counts(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["IDADE"], text=True)
    return (
        enrich.enrich(raw, STAR_COHORT)
        .groupBy("age_band")
        .agg(F.count(F.lit(1)).alias("admissions"), F.min("age").alias("youngest"), F.max("age").alias("oldest"))
    )


@query
def sex_label_counts(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["SEXO"])
    return enrich.enrich(raw, STAR_COHORT).groupBy("sex_code", "sex_label").agg(F.count(F.lit(1)).alias("admissions"))


@query
def tolerant_cast_quality(spark, sf_dir):
    part = star.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"),
        F.substring("p_brand", 7, 10).alias("brand_number"),
        F.substring("p_name", 1, 3).alias("name_start"),
        (F.col("p_size") / F.lit(2.0)).cast("string").alias("half_size"),
        F.col("p_retailprice").alias("price"),
    )
    return enrich.cast_quality(part, ["brand", "brand_number", "name_start", "half_size", "price"])


@query
def months_union(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "MORTE"], text=True)
    early = F.coalesce(F.col("ANO_CMPT").try_cast("int") < 1998, F.lit(False))
    early, late = raw.where(early).drop("MORTE"), raw.where(~early)
    return (
        landing.union_months([early, late])
        .groupBy("ANO_CMPT", "MORTE")
        .agg(F.count(F.lit(1)).alias("admissions"), F.count("DIAG_PRINC").alias("coded"))
    )


@query
def table_conform(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM", "VAL_TOT"], carry=("region",))
    odd = clean.withColumn("stay_days", F.col("stay_days").cast("double")).withColumn(
        "total_value", F.when(F.col("stay_days") == 7, F.lit(float("nan"))).otherwise(F.col("total_value").cast("double"))
    )
    stored = tables.conform(odd, CLEAN)
    return stored.groupBy("diag_group", "year", "age_band").agg(
        F.count(F.lit(1)).alias("admissions"),
        F.count("total_value").alias("valued"),
        F.sum("total_value").alias("total_cost"),
        F.sum("stay_days").alias("stay_days"),
        F.count("death").alias("death_known"),
    )


@query
def repeated_keys(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["CNES", "ANO_CMPT", "MES_CMPT"], text=True)
    return tables.duplicate_keys(raw, ["CNES", "ANO_CMPT", "MES_CMPT"])


@query
def admissions_preview(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "MES_CMPT", "DIAS_PERM", "VAL_TOT"])
    order = [F.col("total_value").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in clean.columns]]
    return tables.preview(clean, order, 5)


@query
def facility_labels(spark, sf_dir):
    raw = star.admissions(spark, sf_dir, ["CNES"], text=True)
    counts = raw.groupBy(F.col("CNES").alias("facility_id")).agg(F.count(F.lit(1)).alias("admissions"))
    facilities = star.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("facility_id"), F.col("s_name").alias("facility")
    )
    return enrich.attach_label(counts, facilities, "facility_id", "facility")


@query
def table_labels(spark, sf_dir):
    """Labels from a table, one for each group that the parts have."""
    group = code_group(F.col("p_type")).alias("diag_group")
    labels = star.table(spark, sf_dir, "part").groupBy(group).agg(F.min("p_type").alias("diag_label"))
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC"])
    clean = enrich.enrich(cohort.select_cohort(raw, STAR_COHORT), STAR_COHORT, labels=labels.where("diag_group IS NOT NULL"))
    return clean.groupBy("diag_group", "diag_label").agg(F.count(F.lit(1)).alias("admissions"))


@query
def guarded_reads(spark, sf_dir):
    """A required, an optional and an absent table, with the rows of each."""
    kinds = {n: T.StructType([T.StructField(c, k) for c, k in star.SCHEMAS[n].items()]) for n in ("part", "supplier")}
    found = {
        "part": landing.require_rows(tables.read_parquet(spark, f"{sf_dir}/part.parquet", kinds["part"]), "part"),
        "supplier": landing.read_optional(spark, f"{sf_dir}/supplier.parquet", kinds["supplier"]),
        "absent": landing.read_optional(spark, f"{sf_dir}/absent.parquet", kinds["part"]),
    }
    none = landing.inline_table(spark, [], kinds["part"])
    counts = [(none if df is None else df).select(F.lit(n).alias("name")).groupBy().agg(F.count("name").alias("rows")).withColumn("name", F.lit(n)) for n, df in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def parsed_fields(spark, sf_dir):
    """Text that is no whole number, no number, or neither, read as whole, nearest and exact numbers."""
    text = T.StringType()
    half = (F.col("p_size") / F.lit(2.0)).cast("string")
    part = star.table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        parse_whole(half, text).alias("whole"),
        parse_int(half, text).alias("nearest"),
        parse_decimal(half, text).alias("exact"),
        parse_whole(F.substring("p_brand", 7, 10), text).alias("brand_whole"),
        parse_int(F.col("p_brand"), text).alias("brand_nearest"),
        parse_decimal(F.substring("p_name", 1, 3), text).alias("name_exact"),
    )


@query
def renamed_on_load(spark, sf_dir):
    """A projection in another's column names, as the typed table takes it."""
    table = projection_table(REGION)
    named = _projection(spark, sf_dir).withColumnsRenamed({"admissions_proj": "ADMISSIONS", "cost_a": "COST_FROZEN"})
    return tables.loadable(named, table, {"ADMISSIONS": "admissions_proj", "COST_FROZEN": "cost_a"})


@query
def table_profile(spark, sf_dir):
    return tables.profile(_clean(spark, sf_dir, ALL_FIELDS))


# --- indicators ---------------------------------------------------------------------------------

GROUPED_FIELDS = ["DIAG_PRINC", "IDADE", "DIAS_PERM", "VAL_TOT", "MORTE", "ANO_CMPT"]


@query
def grouped_admissions(spark, sf_dir):
    return indicators.grouped_admissions(_clean(spark, sf_dir, GROUPED_FIELDS))


@query
def grouped_admissions_by_region(spark, sf_dir):
    clean = _clean(spark, sf_dir, GROUPED_FIELDS, carry=("region",))
    return indicators.grouped_admissions(clean, ["region", *indicators.VIEW_KEYS])


@query
def admissions_by_label(spark, sf_dir):
    return indicators.admissions_by_label(indicators.grouped_admissions(_clean(spark, sf_dir, GROUPED_FIELDS)))


@query
def yearly_history(spark, sf_dir):
    return indicators.yearly_history(_clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM", "VAL_TOT"]))


@query
def yearly_history_by_region(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM"], carry=("region",))
    return indicators.yearly_history(clean, REGION)


@query
def observed_rate(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "IDADE"], carry=("region",))
    population = projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)
    return indicators.observed_rate(clean, population, REGION, unit=1.0)


# --- projection ---------------------------------------------------------------------------------


@query
def interpolated_series(spark, sf_dir):
    return projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)


@query
def projection_by_region(spark, sf_dir):
    return _projection(spark, sf_dir)


@query
def projection_national(spark, sf_dir):
    return _projection(spark, sf_dir, [])


@query
def scenario_costs_wide(spark, sf_dir):
    population = projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)
    projected = projection.project(population, STAR_PROJECTION, REGION)
    wide = projection.scenario_costs(projected, STAR_PROJECTION, REGION)
    return wide.select("region", "year", "cost_a", "cost_b", "cost_c")


@query
def scenario_costs_long(spark, sf_dir):
    population = projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)
    projected = projection.project(population, STAR_PROJECTION, REGION)
    return projection.scenario_costs(projected, STAR_PROJECTION, REGION, wide=False).select(
        "region", "year", "admissions_proj", "scenario", "annual_rate", "cost"
    )


@query
def projection_observed_base(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "VAL_TOT"], carry=("region",))
    base = indicators.base_year_value(clean, STAR_PROJECTION.base_year, REGION)
    return projection.project_costs(
        star.population_anchors(spark, sf_dir), STAR_PROJECTION, REGION, base_values=base
    ).select("region", "year", "admissions_proj", "cost_a", "cost_b", "cost_c")


@query
def projection_observed_rate(spark, sf_dir):
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "IDADE"], carry=("region",))
    population = projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)
    observed = indicators.observed_rate(clean, population, REGION, unit=1.0)
    rates = observed.where(F.col("year") == STAR_PROJECTION.base_year).select(
        "region", F.col("rate_per_100k").alias("rate")
    )
    return projection.project(population, STAR_PROJECTION, REGION, rates)


@query
def projection_milestones(spark, sf_dir):
    return projection.milestones(_projection(spark, sf_dir), STAR_PROJECTION.milestones, REGION)


@query
def trend_slope(spark, sf_dir):
    return projection.linear_trend(_projection(spark, sf_dir), keys=REGION)


@query
def growth_endpoints(spark, sf_dir):
    return projection.endpoint_growth(_projection(spark, sf_dir), keys=REGION)


# --- dashboard and questions --------------------------------------------------------------------


@query
def projection_series(spark, sf_dir):
    return dashboard.projection_series(_projection(spark, sf_dir), STAR_PROJECTION, REGION)


@query
def executive_kpis(spark, sf_dir):
    return indicators.executive_kpis(_projection(spark, sf_dir), STAR_PROJECTION, REGION)


@query
def kpi_headline(spark, sf_dir):
    return dashboard.headline_kpis(_projection(spark, sf_dir), REGION)


@query
def year_comparison(spark, sf_dir):
    return dashboard.compare_years(_projection(spark, sf_dir), 1995, STAR_PROJECTION.end_year, REGION)


@query
def scenario_gap_final_year(spark, sf_dir):
    population = projection.interpolate_series(star.population_anchors(spark, sf_dir), REGION)
    projected = projection.project(population, STAR_PROJECTION, REGION)
    costs = projection.scenario_costs(projected, STAR_PROJECTION, REGION, wide=False)
    return dashboard.scenario_gap(costs, STAR_PROJECTION)


@query
def ageing_summary(spark, sf_dir):
    return dashboard.ageing_summary(_projection(spark, sf_dir, []), STAR_PROJECTION)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = star.admissions(spark, sf_dir, ["DIAG_PRINC", "DIAG_SECUN"])
    return secondary.secondary_profile(raw, STAR_COHORT, DESCRIPTIONS)


@query
def secondary_profile(spark, sf_dir):
    return dashboard.secondary_ranking(_profile(spark, sf_dir))


@query
def secondary_top5(spark, sf_dir):
    return dashboard.top_conditions(_profile(spark, sf_dir), 5)


def _territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions are summed per facility before they meet its region."""
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM", "VAL_TOT", "MORTE", "CNES"])
    facilities = territory.facility_totals(clean).join(star.facility_regions(spark, sf_dir), "facility_id", "left")
    names = star.region_names(spark, sf_dir)
    return territory.territory_table(
        facilities, _projection(spark, sf_dir), names, STAR_TERRITORY, STAR_PROJECTION.base_year
    )


@query
def territory_score(spark, sf_dir):
    return _territory(spark, sf_dir)


@query
def territory_ranking(spark, sf_dir):
    return dashboard.territory_ranking(_territory(spark, sf_dir), STAR_TERRITORY)


@query
def territory_top3(spark, sf_dir):
    return dashboard.top_territories(_territory(spark, sf_dir), 3)


@query
def dashboard_json(spark, sf_dir):
    projected = _projection(spark, sf_dir)
    by_label = indicators.admissions_by_label(indicators.grouped_admissions(_clean(spark, sf_dir, GROUPED_FIELDS)))
    return tables.json_sections(
        {
            "projection": projected.select(
                "region", "year", F.col("pop_millions").cast("decimal(18,2)").alias("POP_MILLIONS"),
                "admissions_proj", "cost_a", "cost_c", "is_projection",
            ),
            "territory": _territory(spark, sf_dir).select("region", "name", "growth_pct", "score", "level"),
            "conditions": _profile(spark, sf_dir),
            "labels": by_label,
        }
    )


# --- written and read again ---------------------------------------------------------------------


def _settled(df: DataFrame, name: str, *places: str) -> DataFrame:
    """A small result, written; what it was read from goes."""
    out = storage.scratch(df.sparkSession, name)
    df.write.parquet(out)
    for place in places:
        storage.remove(df.sparkSession, place)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _landed_clean(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    """Clean rows with the landing file that they stand for: a region's half-year."""
    clean = _clean(spark, sf_dir, [*fields, "ANO_CMPT", "MES_CMPT"], carry=("region",))
    file = {"state": F.col("region").cast("string"), "file_year": F.col("year"), "file_month": F.when(F.col("month") <= 6, 1).otherwise(7)}
    return clean.withColumns(file).drop("region")


@query
def landing_scan(spark, sf_dir):
    """Landing files by region and year, the early ones without deaths and with amounts as text, read through a ledger."""
    root = storage.scratch(spark, "landing")
    fields = ["DIAG_PRINC", "VAL_TOT", "MORTE", "ANO_CMPT", "MES_CMPT", "region"]
    raw = star.admissions(spark, sf_dir, fields).withColumnsRenamed({"region": "state"}).withColumns(
        {"year": F.col("ANO_CMPT"), "month": F.when(F.col("MES_CMPT") <= 6, 1).otherwise(7)}
    )
    early = F.coalesce(F.col("year") < 1998, F.lit(False))
    kinds = (
        raw.where(early).withColumn("VAL_TOT", F.col("VAL_TOT").cast("string")).drop("MORTE"),
        raw.where(~early).withColumn("NEW_FIELD", F.lit(1)),
    )
    scans = []
    for rows in kinds:
        dealt = rows.repartition("state", "year", "month")
        dealt.write.mode("append").partitionBy("state", "year", "month").parquet(f"{root}/files")
        scans.append(landing.read_admissions(spark, f"{root}/files", ledger=f"{root}/ledger"))
    found = scans[-1].groupBy(F.col("state").cast("int").alias("region"), "year", "month").agg(
        F.count(F.lit(1)).alias("admissions"),
        F.count("DIAG_PRINC").alias("coded"),
        F.sum(parse_decimal(F.col("VAL_TOT"), T.StringType())).alias("total_cost"),
        F.sum(F.col("MORTE").cast("int")).alias("deaths"),
    )
    return _settled(found, "landing_scan", root)


@query
def loaded_increments(spark, sf_dir):
    """Two increments and one of them again, in the typed table of admissions: rows as after one load of all."""
    names = ["diag_group", "diag_label", "year", "month", "stay_days", "total_value", "age_band", "death", *COHORT_PARTITIONS]
    table = TableDef(T.StructType([COHORT[n] for n in names]), "Admissions of the checks.", partition_by=COHORT_PARTITIONS, sort_by=("diag_group",))
    clean = _landed_clean(spark, sf_dir, ["DIAG_PRINC", "IDADE", "DIAS_PERM", "VAL_TOT", "MORTE"])
    early = F.coalesce(F.col("year") < 1998, F.lit(False))
    name = f"loaded_{uuid.uuid4().hex}"
    loaded = [tables.load_table(clean.where(part), name, table) for part in (early, ~early, early)]
    found = spark.table(name).groupBy("file_year", "diag_group").agg(
        F.count(F.lit(1)).alias("admissions"), F.sum("total_value").alias("total_cost"), F.sum("stay_days").alias("stay_days")
    )
    counted = F.when(F.coalesce(F.col("file_year") < 1998, F.lit(False)), F.lit(loaded[2])).otherwise(F.lit(loaded[1]))
    out = _settled(found.withColumn("loaded", counted.cast("long")), "loaded_increments")
    spark.sql(f"DROP TABLE {name}")
    return out


@query
def described_columns(spark, sf_dir):
    """A table loaded without comments and again with them: the catalog's comments and the known values of each column."""
    history = indicators.yearly_history(_clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM", "VAL_TOT"]))
    bare = TableDef(T.StructType([T.StructField(f.name, f.dataType) for f in INDICATORS.fields]), "No comments yet.", key=("year",))
    name = f"described_{uuid.uuid4().hex}"
    for table in (bare, TABLES["indicators"]):
        tables.load_table(history, name, table)
    rows = spark.table(name)
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("known")) for c in rows.columns])
    known = rows.agg(counts.alias("counts")).select(F.inline("counts"))
    out = _settled(tables.descriptions(spark, name).join(known, "column"), "described_columns")
    spark.sql(f"DROP TABLE {name}")
    return out


@query
def csv_round_trip(spark, sf_dir):
    """The yearly history of each region, written as CSV and read by name."""
    clean = _clean(spark, sf_dir, ["DIAG_PRINC", "ANO_CMPT", "DIAS_PERM", "VAL_TOT"], carry=("region",))
    schema = T.StructType([T.StructField("region", T.IntegerType()), *INDICATORS.fields])
    place = storage.scratch(spark, "csv")
    tables.write_csv(indicators.yearly_history(clean, REGION), place)
    return tables.read_csv(spark, place, schema)


@query
def csv_unreadable(spark, sf_dir):
    """Parts written with their name for a size in every seventh: the rows that cannot be read are counted."""
    part = star.table(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    place = storage.scratch(spark, "csv")
    tables.write_csv(part.select("p_partkey", size.alias("p_size")), place)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.IntegerType())])
    rows = tables.read_csv(spark, place, schema, keep_unreadable=True)
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(tables.UNREADABLE).alias("unreadable_rows"),
        F.sum("p_size").alias("sizes"),
        F.min(tables.UNREADABLE).alias("example"),
    )
    return _settled(found, "csv_unreadable", place)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all landing files, the later ones first written with every row twice and then replaced."""
    clean = _landed_clean(spark, sf_dir, ["DIAG_PRINC", "IDADE", "DIAS_PERM", "VAL_TOT", "MORTE"])
    early = F.coalesce(F.col("year") < 1998, F.lit(False))
    place = storage.scratch(spark, "states")
    for rows in (clean.where(early), clean.where(~early).unionByName(clean.where(~early)), clean.where(~early)):
        states.write_states(states.admission_states(rows), place)
    return states.read_states(spark, place)


@query
def grouped_from_states(spark, sf_dir):
    return states.merged_admissions(_states(spark, sf_dir))


@query
def history_from_states(spark, sf_dir):
    return states.merged_history(_states(spark, sf_dir))
