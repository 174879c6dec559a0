"""The batch jobs from landing files to the dashboard, through the command line."""

from __future__ import annotations

import json
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardcast import DEMENTIA_COHORT, DEMENTIA_PROJECTION
from wardcast.__main__ import parser, run
from wardcast.operators import indicators
from wardcast.plans import jobs
from wardcast.schemas import COMORBIDITY, RAW, TABLES, TERRITORY
from wardcast.session import GB, scale_settings, sized, stored_bytes
from wardcast.sources import tables


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")

    def month(state, year, month, rows):
        path = f"{root}/landing/state={state}/year={year}/month={month}"
        spark.createDataFrame([tuple(map(str, r)) for r in rows], RAW).write.parquet(path)

    def row(code, second, city, age, sex, days, value, death, year, m, facility):
        return (code, second, city, age, sex, days, value, death, year, m, facility)

    month("SP", 2024, 1, [row("F009", "J18", "3550308", 85, 1, 10, "1000.00", 0, 2024, 1, "A"),
                          row("J189", "F03", "3550308", 85, 1, 10, "1000.00", 1, 2024, 1, "A"),
                          row("G309", "E86", "3509502", 72, 3, 20, "3000.50", 1, 2024, 1, "B")])
    month("SP", 2024, 2, [row("F019", "I10", "3550308", 61, 3, 5, "500.00", 0, 2023, 12, "A")])
    month("RJ", 2024, 1, [row("F03", "I10", "3304557", 90, 3, 7, "700.00", 1, 2024, 1, "C"),
                          row("N390", "G30", "3304557", 90, 3, 7, "700.00", 1, 2024, 1, "C")])
    (root / "anchors.csv").write_text("region,year,pop_millions\nSP,2020,8.0\nSP,2030,10.0\nRJ,2020,3.0\nRJ,2030,3.3\n")
    (root / "names.csv").write_text("region,name\nSP,São Paulo\nRJ,Rio de Janeiro\n")
    return root


def job(spark, *args):
    run(spark, parser().parse_args([str(a) for a in args]))


def test_jobs_end_to_end(spark, root, capsys):
    job(spark, "history", "--cohort", root / "cohort", "--out", root / "history")
    assert "no cohort yet" in capsys.readouterr().out

    select = ["--landing", root / "landing", "--cohort", root / "cohort", "--whole-state", "--ledger", root / "ledger"]
    for _ in range(2):
        job(spark, "cohort", *select)
    assert jobs.read_cohort(spark, str(root / "cohort")).count() == 4
    # One month again: the other month and state stay, also where dates differ from the file's month.
    job(spark, "cohort", *select, "--states", "SP", "--years", 2024, "--months", 1, "--input-gb", 1)
    cohort = jobs.read_cohort(spark, str(root / "cohort"))
    assert sorted(r["diag_code"] for r in cohort.collect()) == ["F009", "F019", "F03", "G309"]

    job(spark, "history", "--cohort", root / "cohort", "--out", root / "history")
    assert "2 years" in capsys.readouterr().out
    read = spark.read.option("header", True).csv
    wanted = sorted(map(str, read(str(root / "history")).collect()))
    # A month's states, written over themselves, merge into the same history.
    for again in ([], ["--states", "SP", "--years", 2024, "--months", 1]):
        job(spark, "states", "--cohort", root / "cohort", "--out", root / "states", *again)
        job(spark, "history", "--cohort", root / "none", "--from-states", root / "states", "--out", root / "merged")
        assert "2 years" in capsys.readouterr().out
        assert sorted(map(str, read(str(root / "merged")).collect())) == wanted
    job(spark, "projection", "--out", root / "projection")
    job(spark, "projection", "--out", root / "by_state", "--anchors", root / "anchors.csv")
    job(spark, "rankings", *select, "--projection", root / "by_state", "--names", root / "names.csv",
        "--territory", root / "territory", "--comorbidity", root / "comorbidity")
    load = ["load", "--cohort", root / "cohort", "--history", root / "history", "--projection", root / "projection",
            "--territory", root / "territory", "--comorbidity", root / "comorbidity", "--prefix", "job_"]
    for _ in range(2):
        job(spark, *load)
        counts = dict(line.split(": ") for line in capsys.readouterr().out.splitlines() if line.startswith(
            ("admissions", "indicators", "projection", "territory", "comorbidity")))
        assert counts == {
            "admissions": "4 rows", "indicators": "2 rows", "projection": "31 rows", "territory": "2 rows",
            "comorbidity": "2 rows",
        }

    history = {r["year"]: tuple(r)[1:] for r in spark.table("job_indicators").collect()}
    assert history[2024] == (3, Decimal("1566.83"), Decimal("12.33"))
    territory = {r["region"]: r for r in spark.table("job_territory").collect()}
    assert territory["SP"]["score"] == 100 and territory["SP"]["name"] == "São Paulo"
    assert territory["SP"]["growth_pct"] == Decimal("25.0")

    job(spark, "dashboard", "--out", root / "dashboard", "--prefix", "job_")
    bodies = {}
    for r in spark.read.text(str(root / "dashboard")).collect():
        bodies.setdefault(r["section"], []).append(json.loads(r["value"]))
    assert set(bodies) == {"projection", "territory", "comorbidity", "labels"}
    assert len(bodies["projection"]) == 31
    assert {r["code"] for r in bodies["comorbidity"]} == {"J18", "N39"}
    assert sum(r["total"] for r in bodies["labels"]) == 4
    view = spark.table("job_grouped_admissions")
    assert view.groupBy().sum("admissions").first()[0] == 4
    assert spark.table("job_executive_kpis").count() == 31


def test_cohort_is_limited_to_the_preset_city(spark, root, tmp_path):
    job(spark, "cohort", "--landing", root / "landing", "--cohort", tmp_path / "c", "--secondary")
    assert jobs.read_cohort(spark, str(tmp_path / "c")).count() == 3


def test_projection_from_observed_rate_and_cost(spark, root, tmp_path):
    cohort = spark.createDataFrame(
        [("SP", 2024, 85, Decimal("1000.00"))] * 2 + [("SP", 2024, 40, Decimal("4000.00")), ("RJ", 2023, 90, Decimal("1.00"))],
        "region string, year int, age int, total_value decimal(15,2)",
    )
    anchors = spark.createDataFrame(
        [("SP", 2024, 0.5), ("SP", 2026, 1.0), ("RJ", 2024, 1.0)], "region string, year int, pop_millions double"
    )
    spec = replace(DEMENTIA_PROJECTION, base_year=2024)
    got = {
        (r["region"], r["year"]): (r["rate_per_100k"], r["admissions_proj"], r["cost_a"])
        for r in jobs.build_projection(anchors, str(tmp_path / "p"), spec, ["region"], cohort).collect()
    }
    # Two of the three admissions are of people over 60: 2 / 500,000 = 0.4 per 100 thousand.
    assert got[("SP", 2026)] == (Decimal("0.40"), 4, Decimal("8000.00"))
    assert got[("RJ", 2024)] == (Decimal("24.25"), 242, Decimal("968000.00"))
    national = spark.createDataFrame([(2024, 0.5), (2025, 1.0)], "year int, pop_millions double")
    rows = jobs.build_projection(national, str(tmp_path / "n"), spec, [], cohort).collect()
    assert [(r["rate_per_100k"], r["admissions_proj"]) for r in rows] == [(Decimal("0.40"), 2), (Decimal("0.40"), 4)]
    before = (tmp_path / "p").stat().st_mtime_ns
    with pytest.raises(PySparkException, match="repeated key"):
        jobs.build_projection(anchors.union(anchors), str(tmp_path / "p"), spec, ["region"])
    assert (tmp_path / "p").stat().st_mtime_ns == before and len(list(tmp_path.glob("p*"))) == 1
    job(spark, "projection", "--out", tmp_path / "o", "--cohort", root / "cohort")


def test_settings_grow_with_the_input():
    small, large = scale_settings(GB, 8), scale_settings(100_000 * GB, 8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert int(large["spark.sql.shuffle.partitions"]) == 400_000
    assert int(large["spark.sql.files.maxPartitionBytes"]) == GB
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 32 * 1024 * 1024


class Settings:
    """A session on which nothing is set yet."""

    class Conf:
        def __init__(self):
            self.values = {}

        def get(self, name, default=None):
            return self.values.get(name, default)

        def set(self, name, value):
            self.values[name] = value

    def __init__(self, spark):
        self.sparkContext, self.conf = spark.sparkContext, self.Conf()


def test_a_job_is_sized_by_the_files_it_names(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a" / "state=SP" / "year=2024"))
    files = sum(p.stat().st_size for p in (tmp_path / "a").rglob("*.parquet"))
    assert files <= stored_bytes(spark, str(tmp_path / "a"), str(tmp_path / "none")) <= files + 100
    stated = spark.newSession()
    sized(stated, input_bytes=1000 * GB)
    assert stated.conf.get("spark.sql.shuffle.partitions") == "8"  # the test session's own setting stands
    unstated = Settings(spark)
    sized(unstated, input_bytes=1000 * GB)
    assert unstated.conf.values["spark.sql.shuffle.partitions"] == "4000"


def test_either_diagnosis_is_reported_as_it_is_written(spark, root, tmp_path):
    raw = jobs.read_landing(spark, str(root / "landing"))
    written = jobs.build_cohort(raw, str(tmp_path / "c"), replace(DEMENTIA_COHORT, region=None), secondary=True)
    retention, labels = jobs.cohort_report(raw, written, replace(DEMENTIA_COHORT, region=None), secondary=True)
    assert retention.first()["rows_kept"] == written.count()
    named = written.where(F.col("diag_group").isin(*DEMENTIA_COHORT.labels)).count()
    assert sum(r["admissions"] for r in labels.collect()) == named < written.count()


def test_a_projection_by_state_reaches_the_dashboard(spark, root, tmp_path, capsys):
    job(spark, "cohort", "--landing", root / "landing", "--cohort", tmp_path / "c", "--whole-state")
    job(spark, "history", "--cohort", tmp_path / "c", "--out", tmp_path / "h")
    job(spark, "projection", "--out", tmp_path / "p", "--anchors", root / "anchors.csv")
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    job(spark, "load", "--cohort", tmp_path / "c", "--history", tmp_path / "h", "--projection", tmp_path / "p",
        "--territory", tmp_path / "t", "--comorbidity", tmp_path / "s", "--prefix", "kept.s_")
    projection = spark.table("kept.s_projection")
    assert projection.columns[0] == "region" and projection.where("pop_millions IS NULL").isEmpty()
    assert {r["region"] for r in projection.select("region").distinct().collect()} >= {"SP"}
    tables.load_table(spark.createDataFrame([], TERRITORY), "kept.s_territory", TABLES["territory"])
    tables.load_table(spark.createDataFrame([], COMORBIDITY), "kept.s_comorbidity", TABLES["comorbidity"])
    job(spark, "dashboard", "--out", tmp_path / "d", "--prefix", "kept.s_")
    bodies = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).where("section = 'projection'").collect()]
    assert len(bodies) == projection.count() and all(b["region"] for b in bodies)
    kinds = {r["viewName"]: r["isTemporary"] for r in spark.sql("SHOW VIEWS IN kept").collect()}
    kinds = {name: kind for name, kind in kinds.items() if name.startswith("s_")}
    assert kinds == {"s_grouped_admissions": False, "s_executive_kpis": False}


def test_stored_views_equal_the_operators(spark, root, tmp_path):
    job(spark, "cohort", "--landing", root / "landing", "--cohort", tmp_path / "c", "--whole-state")
    tables.load_table(jobs.read_cohort(spark, str(tmp_path / "c")), "v_admissions", TABLES["admissions"])
    national = spark.createDataFrame([(2024, 0.5), (2027, 1.0)], "year int, pop_millions double")
    projected = jobs.build_projection(national, str(tmp_path / "p"), DEMENTIA_PROJECTION)
    tables.load_table(projected, "v_projection", TABLES["projection"])
    jobs.create_views(spark, DEMENTIA_PROJECTION, "v_")
    for view, rows in (
        ("v_grouped_admissions", indicators.grouped_admissions(spark.table("v_admissions"))),
        ("v_executive_kpis", indicators.executive_kpis(spark.table("v_projection"), DEMENTIA_PROJECTION)),
    ):
        assert spark.table(view).columns == rows.columns
        assert sorted(map(str, spark.table(view).collect())) == sorted(map(str, rows.collect()))
