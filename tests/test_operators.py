"""Operators on hand-made admissions."""

from __future__ import annotations

import math
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast import DEMENTIA_COHORT, DEMENTIA_TERRITORY
from wardcast.functions import parse_double, right_closed_band
from wardcast.operators import cohort, enrich, indicators, secondary, territory
from wardcast.plans import dashboard
from wardcast.presets import CONDITION_LABELS
from wardcast.spec import CohortSpec

FIELDS = (
    "DIAG_PRINC string, DIAG_SECUN string, MUNIC_RES string, IDADE string, SEXO string, DIAS_PERM string, "
    "VAL_TOT string, MORTE string, ANO_CMPT string, MES_CMPT string, CNES string"
)
ROWS = [
    ("F009", "J189", "3550308", "85", "1", "12", "1234.56", "0", "2024", "1", "A"),
    ("f03", None, "355030", "59.5", "3", "x", "NaN", "1", "2024", "2", "A"),
    ("G301", "F03", "355030", "0", "2", "3", " 7 ", "0", "1e2", "2", "B"),
    ("G30", "E86", "355031", "70", "1.0", "3", "10", "0", "2023", "12", "B"),
    ("J189", "F03", "355030", "81", "3", "4", "20", "1", "2024", "3", "C"),
    ("N390", "f001", "3550308", "82", "3", "5", "30.1", "0", "2.5", "3", "C"),
    (" F00", "X", "355030", "60", "1", "1", "1", "0", "2024", "1", "A"),
    (None, None, "355030", "60", "1", "1", "1", "0", "2024", "1", "A"),
]
EVERYWHERE = replace(DEMENTIA_COHORT, region=None)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, FIELDS)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_select_cohort(raw):
    codes = {r[0] for r in rows(cohort.select_cohort(raw, DEMENTIA_COHORT), "DIAG_PRINC")}
    assert codes == {"F009", "f03", "G301"}
    codes = {r[0] for r in rows(cohort.select_cohort(raw, EVERYWHERE), "DIAG_PRINC")}
    assert codes == {"F009", "f03", "G301", "G30"}


def test_either_diagnosis_keeps_each_row_once(raw):
    kept = rows(cohort.select_cohort(raw, DEMENTIA_COHORT, secondary=True), "DIAG_PRINC")
    assert sorted(r[0] for r in kept) == ["F009", "G301", "J189", "N390", "f03"]


def test_region_test_is_left_out_without_the_column(raw):
    assert cohort.select_cohort(raw.drop("MUNIC_RES"), DEMENTIA_COHORT).count() == 4


def test_numeric_fields_are_compared_as_text(spark):
    typed = spark.createDataFrame(
        [("F00", 3550308, 1, 80.0), ("F00", 3304557, 1, 80.0)], "DIAG_PRINC string, MUNIC_RES int, SEXO int, IDADE double"
    )
    kept = enrich.enrich(cohort.select_cohort(typed, DEMENTIA_COHORT), DEMENTIA_COHORT)
    assert rows(kept, "residence_code", "sex_label", "age_band") == [("3550308", "Masculino", "80-84")]
    as_double = enrich.enrich(typed.withColumn("SEXO", F.lit(1.0)), DEMENTIA_COHORT)
    assert {r[0] for r in rows(as_double, "sex_label")} == {None}


def test_missing_code_column_raises(raw):
    with pytest.raises(ValueError, match="DIAG_PRINC"):
        cohort.select_cohort(raw.drop("DIAG_PRINC"), DEMENTIA_COHORT)
    with pytest.raises(ValueError, match="DIAG_SECUN"):
        cohort.select_cohort(raw.drop("DIAG_SECUN"), DEMENTIA_COHORT, secondary=True)


def test_retention(raw):
    assert rows(cohort.cohort_retention(raw, DEMENTIA_COHORT), "*") == [(8, 4, 3, Decimal("37.500"))]
    assert rows(cohort.cohort_retention(raw.limit(0), DEMENTIA_COHORT), "*") == [(0, 0, 0, Decimal("0.000"))]


def test_label_distribution_lists_every_label_in_order(raw):
    kept = cohort.select_cohort(raw, EVERYWHERE)
    got = rows(cohort.label_distribution(kept, EVERYWHERE), "diag_group", "admissions")
    assert got == [("F00", 1), ("F01", 0), ("F02", 0), ("F03", 1), ("G30", 2)]


def test_uplift(raw):
    assert rows(cohort.secondary_uplift(raw, EVERYWHERE), "*") == [(4, 3, 6, Decimal("1.500"))]
    assert rows(cohort.secondary_uplift(raw.limit(0), EVERYWHERE), "uplift") == [(None,)]


def test_enrich(raw):
    clean = enrich.enrich(cohort.select_cohort(raw, EVERYWHERE), EVERYWHERE)
    assert clean.columns == [
        "diag_code", "diag_secondary", "diag_group", "diag_label", "residence_code", "year", "month", "stay_days",
        "total_value", "age", "age_band", "sex_code", "sex_label", "facility_id", "death",
    ]
    got = rows(
        clean.orderBy("diag_code"), "diag_code", "diag_group", "year", "stay_days", "total_value", "age", "age_band",
        "sex_label", "death",
    )
    assert got == [
        ("F009", "F00", 2024, 12, Decimal("1234.56"), 85, "85+", "Masculino", 0),
        ("G30", "G30", 2023, 3, Decimal("10.00"), 70, "70-74", None, 0),
        ("G301", "G30", 100, 3, Decimal("7.00"), 0, None, None, 0),
        ("f03", "F03", 2024, None, None, 60, "60-69", "Feminino", 1),
    ]


def test_enrich_derives_only_what_exists(raw):
    clean = enrich.enrich(raw.select("DIAG_PRINC", "SEXO", "CNES"), EVERYWHERE, carry=["CNES"])
    assert clean.columns == ["diag_code", "diag_group", "diag_label", "sex_code", "sex_label", "facility_id", "CNES"]


def test_rename_fields(raw):
    assert enrich.rename_fields(raw.select("SEXO", "DIAG_PRINC")).columns == ["diag_code", "sex_code"]


def test_cast_quality(raw):
    got = rows(enrich.cast_quality(raw, ["ANO_CMPT", "VAL_TOT", "DIAS_PERM"]), "*")
    assert got == [("ANO_CMPT", 8, 0, 0, 1), ("VAL_TOT", 8, 0, 1, 2), ("DIAS_PERM", 8, 0, 1, 0)]


def test_yearly_history(raw):
    clean = enrich.enrich(raw, EVERYWHERE)
    got = rows(indicators.yearly_history(clean), "*")
    # The row without a readable year (2.5) is left out; the one without a code is not counted.
    assert got == [
        (100, 1, Decimal("7.00"), Decimal("3.00")),
        (2023, 1, Decimal("10.00"), Decimal("3.00")),
        (2024, 4, Decimal("314.14"), Decimal("4.50")),
    ]


def test_absent_measures_are_null_not_counts(raw):
    clean = enrich.enrich(raw.select("DIAG_PRINC", "ANO_CMPT"), EVERYWHERE)
    assert rows(indicators.yearly_history(clean), "*")[-1] == (2024, 4, None, None)


def test_grouped_view_keeps_null_groups(raw):
    clean = enrich.enrich(raw, EVERYWHERE)
    grouped = indicators.grouped_admissions(clean)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in grouped.collect()}
    assert got[(100, "G30", "Doença de Alzheimer (G30)", None)] == (1, Decimal("7.00"), Decimal("7.00"), Decimal("3.0"), 0)
    assert (2024, None, None, "60-69") in got
    assert grouped.agg(F.sum("admissions")).first()[0] == 8
    assert indicators.admissions_by_label(grouped).agg(F.sum("total")).first()[0] == 8
    assert rows(indicators.admissions_by_label(grouped), "total")[0] == (4,)
    assert [r[0] for r in rows(grouped, "year")][-1] is None


def test_observed_rate(spark, raw):
    clean = enrich.enrich(raw, EVERYWHERE)
    population = spark.createDataFrame([(2024, 0.5), (2023, 0.0)], "year int, pop_millions double")
    got = {r["year"]: r["rate_per_100k"] for r in indicators.observed_rate(clean, population).collect()}
    assert got == {2024: 1.0, 2023: None, 100: None, None: None}


def test_secondary_profile(spark, raw):
    got = rows(secondary.secondary_profile(raw, DEMENTIA_COHORT, CONDITION_LABELS), "*")
    assert got == [("G30", None, 1), ("J18", "Pneumonia", 1), ("N39", "Infecção urinária", 1)]
    dim = spark.createDataFrame([("J18", "lung")], "code string, description string")
    assert ("J18", "lung", 1) in rows(secondary.secondary_profile(raw, DEMENTIA_COHORT, dim), "*")
    assert dashboard.top_conditions(secondary.secondary_profile(raw, DEMENTIA_COHORT), 2).count() == 2


MEASURES = "region string, admissions long, population double, stay_days long, total_value decimal(25,2), deaths long, facilities long"


def test_territory_score_orders_like_the_product(spark):
    data = [
        ("A", 100, 4.0, 500, Decimal("1000"), 10, 5),
        ("B", 90, 4.0, 450, Decimal("900"), 9, 5),
        ("C", 10, 1.0, 50, Decimal("100"), 1, 2),
        ("D", 10, 1.0, 50, Decimal("100"), 0, 2),
    ]
    scored = territory.territory_score(spark.createDataFrame(data, MEASURES), DEMENTIA_TERRITORY)
    got = {r["region"]: (r["raw_score"], r["score"], r["level"]) for r in scored.collect()}
    assert got["A"] == (100.0, 100, "Crítico")
    assert got["B"][0] == pytest.approx(100 * (0.9**4) ** (1 / 6), abs=1e-6)
    assert got["B"][1:] == (93, "Crítico")
    assert got["C"][0] > got["D"][0] == 0.0
    assert got["D"][1:] == (0, "Médio")


def test_levels_tiers_and_ranks(spark):
    scores = [("SP", 91), ("RJ", 84), ("MG", 81), ("BA", 74), ("PR", 70), ("PE", 67), ("XX", 84)]
    df = spark.createDataFrame(scores, "region string, score int").withColumn("name", F.col("region"))
    df = df.withColumn("level", territory.score_level(F.col("score"), DEMENTIA_TERRITORY)).withColumn(
        "growth_pct", F.lit(1)
    )
    got = {r["region"]: (r["level"], r["tier"], r["rank"]) for r in dashboard.territory_ranking(df, DEMENTIA_TERRITORY).collect()}
    assert got == {
        "SP": ("Crítico", 1, 1), "RJ": ("Alto", 2, 2), "XX": ("Alto", 2, 2), "MG": ("Alto", 2, 4),
        "BA": ("Médio-Alto", 2, 5), "PR": ("Médio", 3, 6), "PE": ("Médio", 3, 7),
    }


AGES = st.one_of(st.integers(-5, 210).map(float), st.floats(-5, 210, allow_nan=False))


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(AGES, min_size=1, max_size=60))
def test_every_age_up_to_200_has_exactly_one_band(spark, ages):
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    band = right_closed_band(F.col("age"), EVERYWHERE.age_edges, EVERYWHERE.age_labels)
    for age, label in rows(df, "age", band):
        inside = [
            name
            for low, high, name in zip(EVERYWHERE.age_edges, EVERYWHERE.age_edges[1:], EVERYWHERE.age_labels)
            if low < age <= high
        ]
        assert [label] == (inside or [None])


NUMBERS = st.one_of(
    st.integers(-(10**12), 10**12).map(str),
    st.decimals(-10**9, 10**9, places=3).map(str),
    st.floats(allow_nan=True, allow_infinity=True).map(repr),
    st.text("0123456789+-.eE dfx", max_size=8),
)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NUMBERS, min_size=1, max_size=80))
def test_text_is_read_like_a_plain_float(spark, texts):
    def expected(text):
        try:
            number = float(text)
        except ValueError:
            return None
        return number if math.isfinite(number) else None

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for text, number in rows(df, "x", parse_double(F.col("x"), T.StringType())):
        assert number == expected(text), text


def test_labels_from_a_table(raw, spark):
    """More groups than anyone would type in, in the table's order; a repeated group raises."""
    many = [(i, f"X{i:03}", f"group {i}") for i in range(300)] + [(300, "F00", "zero"), (301, "G30", "thirty")]
    labels = spark.createDataFrame(many, "ord int, diag_group string, diag_label string")
    kept = cohort.select_cohort(raw, EVERYWHERE)
    clean = enrich.enrich(kept, EVERYWHERE, labels=labels)
    assert clean.columns == enrich.enrich(kept, EVERYWHERE).columns
    assert sorted(rows(clean, "diag_group", "diag_label"), key=str) == [
        ("F00", "zero"), ("F03", None), ("G30", "thirty"), ("G30", "thirty"),
    ]
    counted = rows(cohort.label_distribution(kept, EVERYWHERE, labels=labels), "ord", "admissions")
    assert len(counted) == 302 and counted[-2:] == [(300, 1), (301, 2)]
    twice = labels.union(labels.where("ord = 300"))
    for build in (
        lambda: enrich.enrich(kept, EVERYWHERE, labels=twice),
        lambda: cohort.label_distribution(kept, EVERYWHERE, labels=twice),
        lambda: secondary.secondary_profile(raw, EVERYWHERE, twice.selectExpr("diag_group AS code", "diag_label AS description")),
    ):
        df = build()
        with pytest.raises(PySparkException, match="repeated key .*F00"):
            df.collect()
