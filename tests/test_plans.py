"""What the physical plans must look like for the queries to hold up on large data."""

from __future__ import annotations

import re
import uuid

import pytest

from wardcast import DEMENTIA_COHORT
from wardcast.operators import cohort, enrich, indicators
from wardcast.plans.catalogue import QUERIES
from wardcast.schemas import RAW
from wardcast.sources import landing, star


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    row = ("F009", "J18", "3550308", "85", "1", "10", "1000.00", "0", "2024", "1", "A")
    spark.createDataFrame([row], RAW).write.parquet(f"{root}/state=SP/year=2024/month=1")
    return landing.read_admissions(spark, root, states=["SP"], years=[2024])


@pytest.fixture()
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_cohort_tests_reach_the_file_reader(landed):
    text = plan(cohort.select_cohort(landed, DEMENTIA_COHORT), "formatted")
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "StringStartsWith(DIAG_PRINC,F00)" in pushed and "StringStartsWith(DIAG_PRINC,f00)" in pushed
    assert "StringStartsWith(MUNIC_RES,355030)" in pushed
    assert "year#" in re.search(r"PartitionFilters: (.*)", text).group(1)


def test_select_and_enrich_move_no_rows(landed):
    text = plan(enrich.enrich(cohort.select_cohort(landed, DEMENTIA_COHORT), DEMENTIA_COHORT))
    assert "Exchange" not in text and "Join" not in text


def test_only_needed_fields_are_read(landed):
    clean = enrich.enrich(cohort.select_cohort(landed, DEMENTIA_COHORT), DEMENTIA_COHORT)
    text = plan(indicators.yearly_history(clean), "formatted")
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "DIAG_PRINC", "MUNIC_RES", "DIAS_PERM", "VAL_TOT", "ANO_CMPT",
    }


def test_retention_reads_two_fields_once(landed):
    text = plan(cohort.cohort_retention(landed, DEMENTIA_COHORT), "formatted")
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"DIAG_PRINC", "MUNIC_RES"}


def test_one_shuffle_per_aggregate(landed):
    clean = enrich.enrich(cohort.select_cohort(landed, DEMENTIA_COHORT), DEMENTIA_COHORT)
    text = plan(indicators.admissions_by_label(indicators.grouped_admissions(clean)))
    assert text.count("Exchange hashpartitioning") == 2
    # The view's own order by year is gone; the label order remains.
    assert text.count("Exchange rangepartitioning") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_and_no_row_by_row_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for word in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in text, word


def test_orders_are_counted_before_they_meet_customers(spark, sf_dir, no_broadcast):
    text = plan(star.population_anchors(spark, sf_dir))
    orders = text[: text.index("FileScan parquet [o_")]
    assert orders.rstrip().split("\n")[-1].count("Exchange") == 0
    assert text.index("partial_sum") < text.index("partial_count")


def test_growing_dimensions_are_broadcast_by_size_only(spark, sf_dir, no_broadcast):
    text = plan(star.admissions(spark, sf_dir, ["DIAG_PRINC", "MUNIC_RES"]))
    assert text.count("SortMergeJoin") == 2
    assert text.count("BroadcastHashJoin") == 1  # the 25 nations


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n not in ("dashboard_json",)])
def test_no_order_is_filtered(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir), "formatted")
    for filters in re.findall(r"PushedFilters: (.*)|Condition : (.*)", text):
        assert "o_orderdate" not in "".join(filters)


def test_anchors_account_for_all_orders(spark, sf_dir):
    many = star.table(spark, sf_dir, "orders").count()
    for keys in ([], ["region"]):
        periods = star.orders_per_period(spark, sf_dir, keys)
        assert periods.agg({"orders": "sum"}).first()[0] == many
        days = {r["year"]: r["days"] for r in periods.collect()}
        assert days[1995] == 1096 and days[1998] == 1096 and days[2001] < 365


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
@pytest.mark.parametrize("name", ["territory_score", "territory_ranking", "territory_top3", "projection_observed_rate"])
def test_tables_are_read_once(spark, sf_dir, name, threshold):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": threshold,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": threshold,
        "spark.sql.maxPlanStringLength": str(10**8),
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        final = executed(df._jdf.queryExecution().executedPlan().toString())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(re.findall(r"FileScan parquet \[l_", final)) == 1
    assert len(re.findall(r"FileScan parquet \[o_", final)) == 1
    assert "ReusedExchange" in final


def executed(text):
    """The plan without the initial plans that adaptive execution prints next to the final ones."""
    kept, skip = [], None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth >= skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


#: Queries that write, and one that looks whether there are rows.
WITH_JOBS = {"landing_scan", "loaded_increments", "described_columns", "csv_round_trip", "csv_unreadable", "grouped_from_states", "history_from_states", "guarded_reads"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_JOBS))
def test_building_a_query_starts_no_job(spark, sf_dir, name):
    group = f"building-{name}-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        QUERIES[name](spark, sf_dir)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
