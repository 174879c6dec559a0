from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardcast import DEMENTIA_PROJECTION
from wardcast.operators import projection as P
from wardcast.operators.indicators import executive_kpis
from wardcast.plans import dashboard
from wardcast.presets import BRAZIL_60_PLUS
from wardcast.schemas import ANCHORS
from wardcast.sources.landing import inline_table

# year, population, admissions, cost a, b, c
GOLDEN = """
2020 29.90 7251 29004000.00 29004000.00 29004000.00
2021 30.84 7479 29916000.00 29916000.00 29916000.00
2022 31.78 7707 30828000.00 30828000.00 30828000.00
2023 32.72 7935 31740000.00 31740000.00 31740000.00
2024 33.66 8163 32652000.00 32652000.00 32652000.00
2025 34.60 8390 33560000.00 33560000.00 33560000.00
2026 35.74 8667 34668000.00 35274690.00 35881380.00
2027 36.88 8943 35772000.00 37034975.18 38319860.70
2028 38.02 9220 36880000.00 38850281.15 40889515.23
2029 39.16 9496 37984000.00 40713493.44 43587513.66
2030 40.30 9773 39092000.00 42634382.73 46429033.06
2031 41.66 10103 40412000.00 44845291.54 49676666.25
2032 43.02 10432 41728000.00 47116008.88 53089669.08
2033 44.38 10762 43048000.00 49457062.99 56685995.42
2034 45.74 11092 44368000.00 51865624.72 60469029.77
2035 47.10 11422 45688000.00 54343339.88 64447436.18
2036 48.42 11742 46968000.00 56843480.83 68571857.68
2037 49.74 12062 48248000.00 59414484.07 72906040.58
2038 51.06 12382 49528000.00 62058064.10 77459615.76
2039 52.38 12702 50808000.00 64775973.75 82242631.30
2040 53.70 13022 52088000.00 67570004.96 87265569.90
2041 54.78 13284 53136000.00 70135766.01 92137082.21
2042 55.86 13546 54184000.00 72770635.38 97242700.07
2043 56.94 13808 55232000.00 75476246.09 102592843.25
2044 58.02 14070 56280000.00 78254267.18 108198374.14
2045 59.10 14332 57328000.00 81106404.41 114070615.96
2046 60.18 14594 58376000.00 84034401.06 120221371.71
2047 61.26 14856 59424000.00 87040038.77 126662943.85
2048 62.34 15117 60468000.00 90119176.81 133399330.40
2049 63.42 15379 61516000.00 93285494.45 140461235.22
2050 64.50 15641 62564000.00 96535034.20 147854059.20
"""


@pytest.fixture(scope="module")
def anchors(spark):
    return inline_table(spark, BRAZIL_60_PLUS, ANCHORS)


@pytest.fixture(scope="module")
def projection(anchors):
    return P.project_costs(anchors, DEMENTIA_PROJECTION)


def test_golden_projection(projection):
    expected = []
    for line in GOLDEN.split("\n")[1:-1]:
        year, pop, admissions, *costs = line.split()
        flag = int(int(year) > 2025)
        expected.append((int(year), float(pop), 24.25, int(admissions), *map(Decimal, costs), flag))
    assert [tuple(r) for r in projection.orderBy("year").collect()] == expected


def test_long_form_equals_wide(anchors, projection):
    projected = P.project(P.interpolate_series(anchors), DEMENTIA_PROJECTION)
    long = P.scenario_costs(projected, DEMENTIA_PROJECTION, wide=False)
    pivoted = long.groupBy("year").pivot("scenario", ["a", "b", "c"]).agg(F.first("cost"))
    wide = projection.select("year", "cost_a", "cost_b", "cost_c")
    assert {tuple(r) for r in pivoted.collect()} == {tuple(r) for r in wide.collect()}
    assert long.count() == 3 * 31


def test_trend_and_growth(projection):
    assert P.linear_trend(projection).first()["slope"] == pytest.approx(291.246371, abs=1e-6)
    growth = P.endpoint_growth(projection).first()
    assert (growth["first_value"], growth["last_value"], growth["growth_pct"]) == (7251, 15641, Decimal("115.708"))


def test_headline(projection):
    row = dashboard.headline_kpis(projection).first()
    assert (row["admissions_text"], row["growth_text"], row["pop_text"], row["rate_text"]) == (
        "15.641", "+116%", "64,5", "24,25",
    )


def test_milestones(projection):
    got = [tuple(r) for r in P.milestones(projection, DEMENTIA_PROJECTION.milestones).collect()]
    assert got == [
        (2020, 29.9, 7251), (2025, 34.6, 8390), (2030, 40.3, 9773), (2035, 47.1, 11422), (2040, 53.7, 13022),
        (2050, 64.5, 15641),
    ]


def test_questions(anchors, projection):
    assert tuple(dashboard.compare_years(projection, 2020, 2050).first()) == (7251, 15641, 8390, Decimal("115.708"))
    projected = P.project(P.interpolate_series(anchors), DEMENTIA_PROJECTION)
    gap = dashboard.scenario_gap(P.scenario_costs(projected, DEMENTIA_PROJECTION, wide=False), DEMENTIA_PROJECTION).first()
    assert (gap["frozen_cost"], gap["full_cost"]) == (Decimal("62564000.00"), Decimal("147854059.20"))
    assert gap["gap"] == Decimal("85290059.20")
    summary = dashboard.ageing_summary(projection, DEMENTIA_PROJECTION).first()
    assert (summary["first_value"], summary["last_value"], summary["gap"]) == (7251, 15641, Decimal("85290059.20"))
    kpi = executive_kpis(projection, DEMENTIA_PROJECTION).collect()[-1]
    assert (kpi["cost_a_millions"], kpi["cost_c_millions"]) == (Decimal("62.56"), Decimal("147.85"))
    chart = dashboard.projection_series(projection, DEMENTIA_PROJECTION).collect()[-1]
    assert (chart["cost_a_chart"], chart["cost_c_chart"]) == (Decimal("62.6"), Decimal("147.9"))


def test_observed_rate_and_base_value(spark, anchors):
    rates = spark.createDataFrame([(48.5,)], "rate double")
    base = spark.createDataFrame([(Decimal("2000.00"),)], "base_value decimal(15,2)")
    row = P.project_costs(anchors, DEMENTIA_PROJECTION, rates=rates, base_values=base).where("year = 2030").first()
    assert row["admissions_proj"] == 19546 and row["rate_per_100k"] == 48.5
    assert row["cost_a"] == Decimal("39092000.00")
    none = spark.createDataFrame([(None,)], "rate double")
    assert P.project_costs(anchors, DEMENTIA_PROJECTION, rates=none).where("year = 2030").first()["admissions_proj"] == 9773


def test_rates_by_region_fall_back_to_the_spec(spark):
    anchors = spark.createDataFrame(
        [("x", 2020, 10.0), ("x", 2022, 20.0), ("y", 2020, 10.0)], "region string, year int, pop_millions double"
    )
    rates = spark.createDataFrame([("x", 10.0)], "region string, rate double")
    got = {(r["region"], r["year"]): r["admissions_proj"] for r in P.project_costs(anchors, DEMENTIA_PROJECTION, ["region"], rates=rates).collect()}
    assert got == {("x", 2020): 1000, ("x", 2021): 1500, ("x", 2022): 2000, ("y", 2020): 2425}


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.tuples(st.sampled_from("abc"), st.integers(1990, 2060)),
        st.integers(0, 10_000).map(lambda cents: cents / 100),
        min_size=1,
        max_size=12,
    )
)
def test_series_passes_through_every_anchor(spark, points):
    rows = [(k, y, v) for (k, y), v in points.items()]
    anchors = spark.createDataFrame(rows, "region string, year int, pop_millions double")
    got = {(r[0], r[1]): r[2] for r in P.interpolate_series(anchors, ["region"]).collect()}
    assert {key: got[key] for key in points} == points
    for region in {k for k, _ in points}:
        years = [y for k, y in points if k == region]
        assert sorted(y for k, y in got if k == region) == list(range(min(years), max(years) + 1))
