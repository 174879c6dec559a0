"""Sources and sinks."""

from __future__ import annotations

import gzip
import json
import uuid
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.schemas import ANCHORS, CLEAN, COMORBIDITY, INDICATORS, RAW, TABLES, TableDef, projection_table
from wardcast.sources import landing, tables

RAW_FIELDS = "DIAG_PRINC string, MUNIC_RES string"


def write_month(spark, root, state, year, month, rows, fields=RAW_FIELDS):
    path = f"{root}/state={state}/year={year}/month={month}"
    spark.createDataFrame(rows, fields).write.mode("overwrite").parquet(path)


@pytest.fixture()
def landed(spark, tmp_path):
    root = str(tmp_path / "landing")
    write_month(spark, root, "SP", 2024, 1, [("F00", "1"), ("G30", "2")])
    write_month(spark, root, "SP", 2024, 2, [("F01",)], "DIAG_PRINC string")
    write_month(spark, root, "RJ", 2023, 1, [("F02", "3")])
    return root


def test_landing_selects_by_partition(spark, landed):
    every = landing.read_admissions(spark, landed)
    assert every.columns == RAW.fieldNames() + ["state", "year", "month"]
    assert every.count() == 4
    some = landing.read_admissions(spark, landed, states=["SP"], years=[2024], months=[2])
    assert [(r["DIAG_PRINC"], r["MUNIC_RES"], r["CNES"]) for r in some.collect()] == [("F01", None, None)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_landing_csv_is_read_as_text(spark, tmp_path):
    path = tmp_path / "csv" / "state=SP" / "year=2024" / "month=1"
    path.mkdir(parents=True)
    (path / "a.csv").write_text("DIAG_PRINC,DIAG_SECUN\nF00,0123\n")
    fields = T.StructType(RAW.fields[:2])
    got = landing.read_admissions(spark, str(tmp_path / "csv"), file_format="csv", fields=fields)
    assert [tuple(r) for r in got.collect()] == [("F00", "0123", "SP", 2024, 1)]


def test_empty_selection_raises(spark, landed):
    with pytest.raises(landing.NoRowsError):
        landing.require_rows(landing.read_admissions(spark, landed, years=[1999]))
    assert landing.require_rows(landing.read_admissions(spark, landed)).count() == 4


def test_union_of_months_with_different_columns(spark):
    a = spark.createDataFrame([("F00", "1")], "code string, sex string")
    b = spark.createDataFrame([("F01",)], "code string")
    assert sorted(landing.union_months([a, b]).collect(), key=str) == [("F00", "1"), ("F01", None)]


def test_optional_input(spark, tmp_path):
    assert landing.read_optional(spark, str(tmp_path / "none"), INDICATORS) is None
    tables.write_csv(spark.createDataFrame([(2024, 1, None, None)], INDICATORS), str(tmp_path / "some"))
    assert landing.read_optional(spark, str(tmp_path / "some"), INDICATORS, "csv").count() == 1


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(2024, 5, Decimal("1.50"), None), (2025, 6, None, Decimal("2.25"))], INDICATORS
    )
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_parquet(df, str(tmp_path / "p"))
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), INDICATORS).collect())) == want
    assert sorted(map(tuple, tables.read_parquet(spark, str(tmp_path / "p"), INDICATORS).collect())) == want


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.createDataFrame([(1, 2023), (2, 2024)], "v int, year int"), path, ["year"])
    tables.write_parquet(spark.createDataFrame([(3, 2024)], "v int, year int"), path, ["year"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2023), (3, 2024)]


def test_conform(spark):
    df = spark.createDataFrame([(2024.0, float("nan"), "x"), (2025.0, 1.005, "y")], "year double, mean_value double, z string")
    got = tables.conform(df, INDICATORS)
    assert got.schema.fieldNames() == INDICATORS.fieldNames()
    assert [f.dataType for f in got.schema.fields] == [f.dataType for f in INDICATORS.fields]
    assert got.schema["year"].metadata["comment"] == "Year."
    assert [tuple(r) for r in got.collect()] == [(2024, None, None, None), (2025, None, Decimal("1.01"), None)]
    with pytest.raises(ValueError):
        tables.conform(df.select("z"), INDICATORS)


@pytest.mark.parametrize(
    ("value", "kind", "field"),
    [("12x", "string", "year"), ("x" * 11, "string", "diag_code"), (1e15, "double", "total_value")],
)
def test_values_that_do_not_fit(spark, value, kind, field):
    df = spark.createDataFrame([(value,)], f"{field} {kind}")
    with pytest.raises(PySparkException, match=f"{field}: value does not fit"):
        tables.conform(df, CLEAN).collect()
    assert tables.conform(df, CLEAN, strict=False).first()[field] is None


def test_duplicate_key_stops_the_load(spark):
    df = spark.createDataFrame([("J18", 1), ("J18", 2), ("N39", 1)], "code string, admissions long")
    with pytest.raises(tables.DuplicateKeyError, match="J18"):
        tables.load_table(df, "dup_conditions", TABLES["comorbidity"])
    assert not spark.catalog.tableExists("dup_conditions")


def test_loading_twice_is_loading_once(spark):
    df = spark.createDataFrame([("J18", "Pneumonia", 380), ("N39", None, 210)], COMORBIDITY)
    assert tables.load_table(df, "conditions", TABLES["comorbidity"]) == 2
    assert tables.load_table(df, "conditions", TABLES["comorbidity"]) == 2
    admissions = TableDef(
        T.StructType([f for f in CLEAN.fields if f.name in ("diag_code", "year", "death")]), "It's a test.", partition_by=("year",)
    )
    first = spark.createDataFrame([("F00", 2023, 0), ("F01", 2024, 1), ("F01", None, 1)], "diag_code string, ano int, death int")
    for _ in range(2):
        assert tables.load_table(first, "adm", admissions, {"ano": "year"}) == 3
    later = spark.createDataFrame([("G30", 2024, 0)], "diag_code string, year int, death int")
    assert tables.load_table(later, "adm", admissions) == 1
    got = {(r["diag_code"], r["year"]) for r in spark.table("adm").collect()}
    assert got == {("F00", 2023), ("G30", 2024), ("F01", None)}


def test_tables_are_described(spark):
    df = spark.createDataFrame([("J18", "Pneumonia", 380)], COMORBIDITY)
    tables.load_table(df, "described", TABLES["comorbidity"])
    details = {r["col_name"]: (r["data_type"], r["comment"]) for r in spark.sql("DESCRIBE EXTENDED described").collect()}
    assert details["description"][1] == COMORBIDITY["description"].metadata["comment"]
    assert details["Comment"][0] == TABLES["comorbidity"].comment


def test_json_rows_keep_nulls_and_lower_case(spark):
    df = spark.createDataFrame([(1, None)], "YEAR int, Label string")
    assert json.loads(tables.json_rows(df).first()["body"]) == {"year": 1, "label": None}


def test_json_sections(spark, tmp_path):
    frames = {"a": spark.range(2), "b": spark.createDataFrame([("x",)], "name string")}
    tables.write_json_sections(frames, str(tmp_path / "j"))
    got = spark.read.text(str(tmp_path / "j")).groupBy("section").agg(F.sort_array(F.collect_list("value")).alias("v"))
    assert {r["section"]: r["v"] for r in got.collect()} == {"a": ['{"id":0}', '{"id":1}'], "b": ['{"name":"x"}']}


def test_jdbc_append_is_conformed_and_batched(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    calls = []
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: calls.append((k, v)) or self)
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, *args, **kw: calls.append((self._df.columns, args, kw)))
    df = spark.createDataFrame([("J18", 380, "x")], "code string, admissions long, other string")
    tables.write_jdbc(df, "jdbc:any", "conditions", {"user": "u"}, TABLES["comorbidity"])
    assert calls == [
        ("batchsize", 500),
        (["code", "description", "admissions"], ("jdbc:any", "conditions"), {"mode": "append", "properties": {"user": "u"}}),
    ]


def test_profile_and_preview(spark):
    df = spark.range(9).withColumn("x", -F.col("id"))
    assert tuple(tables.profile(df).first()) == (9, 2)
    assert [r["id"] for r in tables.preview(df, [F.col("x").asc()]).collect()] == [8, 7, 6, 5, 4]


def month(spark, state, year, month, codes):
    rows = [(c, state, year, month, 1999) for c in codes]
    return spark.createDataFrame(rows, "diag_code string, state string, file_year int, file_month int, year int")


def test_an_increment_keeps_what_was_loaded(spark):
    """The rows' own year is the same everywhere: what a load replaces is the landing file that they came from."""
    table = TABLES["admissions"]
    for part, loaded in (
        (month(spark, "SP", 2024, 1, ["F00", "F01", "F02"]), 3),
        (month(spark, "SP", 2024, 2, ["F03", "F03"]), 2),
        (month(spark, "RJ", 2024, 1, ["G30"]), 1),
        (month(spark, "SP", 2024, 1, ["F00"]), 1),
    ):
        assert tables.load_table(part, "increments", table) == loaded
    got = sorted((r.state, r.file_month, r.diag_code) for r in spark.table("increments").collect())
    assert got == [("RJ", 1, "G30"), ("SP", 1, "F00"), ("SP", 2, "F03"), ("SP", 2, "F03")]


def test_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("admissions,code\n5,J18\n")
    got = tables.read_csv(spark, str(tmp_path / "t"), COMORBIDITY)
    assert got.columns == COMORBIDITY.names and tuple(got.first()) == ("J18", None, 5)
    (tmp_path / "t" / "b.csv").write_text("code,admissions\nN39,6\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        tables.read_csv(spark, str(tmp_path / "t"), COMORBIDITY).collect()
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.csv").write_text("code,rows\nJ18,5\n")
    with pytest.raises(tables.UnexpectedHeaderError, match="rows"):
        tables.read_csv(spark, str(tmp_path / "u"), COMORBIDITY)


def test_a_projection_per_region_has_the_region_in_its_key(spark):
    rows = [("SP", 2024, 1), ("RJ", 2024, 2)]
    table = projection_table(["region"])
    assert table.key == ("region", "year")
    df = spark.createDataFrame(rows, "region string, year int, admissions_proj long")
    assert tables.load_table(df, "projection_by_region_table", table) == 2
    with pytest.raises(tables.DuplicateKeyError):
        tables.load_table(df, "projection_national_table", TABLES["projection"])


def files(root, state, month, name, text):
    path = root / f"state={state}" / "year=2024" / f"month={month}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)


def test_landing_csv_is_matched_by_name(spark, tmp_path):
    files(tmp_path, "SP", 1, "a.csv", "DIAG_PRINC,DIAG_SECUN,IDADE\nF00,J18,81\n")
    files(tmp_path, "SP", 2, "a.csv", "IDADE,OTHER,DIAG_PRINC\n82,x,F01\n")
    files(tmp_path, "SP", "03", "a.csv", "DIAG_PRINC,IDADE\nF02,83\n")
    files(tmp_path, "RJ", 1, "a.csv", "DIAG_PRINC,IDADE\nF03,84\n")
    got = landing.read_admissions(spark, str(tmp_path), file_format="csv")
    assert got.columns == RAW.names + ["state", "year", "month"]
    seen = sorted((r["DIAG_PRINC"], r["DIAG_SECUN"], r["IDADE"], r["MUNIC_RES"], r["state"], r["month"]) for r in got.collect())
    assert seen == [
        ("F00", "J18", "81", None, "SP", 1), ("F01", None, "82", None, "SP", 2),
        ("F02", None, "83", None, "SP", 3), ("F03", None, "84", None, "RJ", 1),
    ]
    some = landing.read_admissions(spark, str(tmp_path), states=["SP"], months=[2, 3], file_format="csv")
    assert sorted(r["DIAG_PRINC"] for r in some.collect()) == ["F01", "F02"]
    files(tmp_path, "SP", 1, "b.csv", "IDADE,DIAG_PRINC,DIAG_SECUN\n85,F09,J19\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        landing.read_admissions(spark, str(tmp_path), file_format="csv").collect()


def test_landing_parquet_takes_any_type(spark, tmp_path):
    root = str(tmp_path / "p")
    write_month(spark, root, "SP", 2024, 1, [("F00", 81, 12.5)], "DIAG_PRINC string, IDADE int, VAL_TOT double")
    write_month(spark, root, "SP", 2024, 2, [("F01", "82", Decimal("7.25"))], "DIAG_PRINC string, IDADE string, VAL_TOT decimal(9,2)")
    write_month(spark, root, "SP", 2024, 3, [(7, "F02")], "extra int, DIAG_PRINC string")
    got = landing.read_admissions(spark, root)
    assert {f.dataType for f in got.schema.fields[: len(RAW)]} == {T.StringType()}
    seen = sorted((r["DIAG_PRINC"], r["IDADE"], r["VAL_TOT"]) for r in got.collect())
    assert seen == [("F00", "81", "12.5"), ("F01", "82", "7.25"), ("F02", None, None)]
    with pytest.raises(PySparkException):
        landing.read_admissions(spark, str(tmp_path / "none"))


def test_landing_parquet_files_of_one_directory_may_lack_columns(spark, tmp_path):
    month = str(tmp_path / "state=SP" / "year=2024" / "month=1")
    spark.createDataFrame([("F00",)], "DIAG_PRINC string").coalesce(1).write.parquet(month)
    spark.createDataFrame([("F01", 82)], "DIAG_PRINC string, IDADE int").coalesce(1).write.mode("append").parquet(month)
    spark.createDataFrame([("F02", 1.5)], "DIAG_PRINC string, VAL_TOT double").coalesce(1).write.mode("append").parquet(month)
    got = landing.read_admissions(spark, str(tmp_path)).collect()
    seen = sorted((r["DIAG_PRINC"], r["IDADE"], r["VAL_TOT"]) for r in got)
    assert seen == [("F00", None, None), ("F01", "82", None), ("F02", None, "1.5")]
    spark.createDataFrame([("F03", "83")], "DIAG_PRINC string, IDADE string").coalesce(1).write.mode("append").parquet(month)
    with pytest.raises(Exception, match="Failed to merge incompatible data types"):
        landing.read_admissions(spark, str(tmp_path))


def jobs_of(spark, build):
    """What ``build`` returns, and the number of Spark jobs that it started."""
    group = f"group-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        made = build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def counted(spark, rows, kinds):
    """The rows, and a counter of how many have been evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, kinds)
    return df.mapInArrow(each, df.schema), seen


@pytest.mark.parametrize("name", ["comorbidity", "admissions"])
def test_a_load_evaluates_its_input_once(spark, name):
    kinds = {"comorbidity": "code string, admissions long", "admissions": "diag_code string, file_month int"}[name]
    for _ in range(2):
        df, seen = counted(spark, [(f"F{i}", i) for i in range(10)], kinds)
        assert tables.load_table(df, f"once_{name}", TABLES[name]) == 10
        assert seen.value == 10
    assert spark.table(f"once_{name}").count() == 10


@pytest.mark.parametrize("bad", [("J18", 1), ("x" * 11, 1)])
def test_a_failed_load_leaves_the_table(spark, bad):
    name = f"kept_{len(bad[0])}"
    tables.load_table(spark.createDataFrame([("J18", 7)], "code string, admissions long"), name, TABLES["comorbidity"])
    home = spark.catalog.getDatabase("default").locationUri.removeprefix("file:")
    before = {p.name for p in Path(home).iterdir()}
    with pytest.raises((tables.DuplicateKeyError, PySparkException)):
        tables.load_table(spark.createDataFrame([("J18", 1), bad], "code string, admissions long"), name, TABLES["comorbidity"])
    assert [(r["code"], r["admissions"]) for r in spark.table(name).collect()] == [("J18", 7)]
    assert {p.name for p in Path(home).iterdir()} == before


def test_tables_are_dropped_with_their_files(spark):
    home = Path(spark.catalog.getDatabase("default").locationUri.removeprefix("file:"))
    for _ in range(3):
        tables.load_table(spark.createDataFrame([("J18", 7)], "code string, admissions long"), "gone", TABLES["comorbidity"])
    assert len(list(home.glob("gone*"))) == 1
    spark.sql("DROP TABLE gone")
    assert not list(home.glob("gone*"))
    assert tables.load_table(spark.createDataFrame([("J18", 7)], "code string, admissions long"), "gone", TABLES["comorbidity"]) == 1


def test_changed_comments_reach_an_existing_table(spark):
    old = TABLES["comorbidity"]
    df = spark.createDataFrame([("J18", 7)], "code string, admissions long")
    tables.load_table(df, "commented", old)
    assert tables.describe_table(spark, "commented", old) == []
    fields = [T.StructField("code", T.StringType(), True, {"comment": "It's new."}), *old.schema.fields[1:]]
    new = TableDef(T.StructType(fields), "Another \\ comment", key=old.key)
    assert tables.describe_table(spark, "commented", new) == ["commented", "code"]
    tables.load_table(df, "commented", new)
    assert {r["column"]: r["comment"] for r in tables.descriptions(spark, "commented").collect()}["code"] == "It's new."
    assert spark.catalog.getTable("commented").description == "Another \\ comment"


def test_unreadable_csv_cells_are_not_lost(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("year,pop_millions\nabc,34.6\n2030,x\n2031,40.3\n2032,41,9\n")
    with pytest.raises(PySparkException, match="unreadable row: (abc,34.6|2030,x|2032,41,9)"):
        tables.read_csv(spark, str(tmp_path / "t"), ANCHORS).count()
    with pytest.raises(PySparkException, match="unreadable row"):
        tables.read_csv(spark, str(tmp_path / "t"), ANCHORS).select("year").collect()
    got = tables.read_csv(spark, str(tmp_path / "t"), ANCHORS, keep_unreadable=True).collect()
    assert {r["unreadable"] for r in got} == {"abc,34.6", "2030,x", None, "2032,41,9"}
    assert [(r["year"], r["pop_millions"]) for r in got if r["unreadable"] is None] == [(2031, 40.3)]
    assert [(r["year"], r["pop_millions"]) for r in got if r["unreadable"] == "abc,34.6"] == [(None, 34.6)]
    assert tuple(tables.csv_quality(spark, str(tmp_path / "t"), ANCHORS).first()) == (4, 3, "2030,x")


def test_files_are_replaced_when_all_are_written(spark, tmp_path):
    for write in (tables.write_csv, tables.write_parquet):
        path = str(tmp_path / write.__name__)
        write(spark.range(5), path)
        with pytest.raises(PySparkException):
            write(spark.range(5).withColumn("x", F.raise_error(F.lit("no"))), path)
        assert len(list(tmp_path.glob(f"{write.__name__}*"))) == 1
        write(spark.range(3), path)
        assert spark.read.format(write.__name__.removeprefix("write_")).load(path).count() >= 3


def test_sorted_files_let_readers_skip_row_groups(spark, tmp_path):
    number = F.lpad((F.col("id") * 7919 % 1000).cast("string"), 3, "0")
    codes = spark.range(40_000).select(F.concat(F.lit("F"), number, F.md5(F.col("id").cast("string"))).alias("diag_code"), F.lit("SP").alias("state"))

    def groups(sort_by):
        path = str(tmp_path / f"s{len(sort_by)}")
        blocked = spark.sparkContext._jsc.hadoopConfiguration()
        blocked.set("parquet.block.size", "20000")
        blocked.set("parquet.page.size", "4000")
        try:
            tables.write_parquet(codes, path, ["state"], sort_by)
        finally:
            blocked.unset("parquet.block.size")
            blocked.unset("parquet.page.size")
        stats = []
        for file in Path(path).rglob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            stats += [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        assert spark.read.parquet(path).where(F.col("diag_code").startswith("F12")).count() == 400
        return len(stats), sum(s.min <= "F13" and s.max >= "F12" for s in stats)

    every, read = groups(())
    sorted_every, sorted_read = groups(("diag_code",))
    assert read == every > 2 and sorted_every > 2
    assert sorted_read <= max(2, sorted_every // 3)


def test_a_ledger_is_asked_before_the_files(spark, landed, monkeypatch):
    ledger, looked, look = landed + "-ledger", [], landing._merged_columns
    monkeypatch.setattr(landing, "_merged_columns", lambda *args: looked.append([d for d, _ in args[1]]) or look(*args))
    first = landing.read_admissions(spark, landed, ledger=ledger)
    again = landing.read_admissions(spark, landed, ledger=ledger)
    assert [len(d) for d in looked] == [3]
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    rows = spark.read.parquet(ledger)
    assert rows.count() == 3 and rows.select("directory").distinct().count() == 3
    write_month(spark, landed, "SP", 2024, 2, [("F01", "9"), ("F02", "8")])
    write_month(spark, landed, "SP", 2024, 3, [("F03", 3)], "DIAG_PRINC string, MUNIC_RES int")
    more = landing.read_admissions(spark, landed, ledger=ledger)
    assert sorted(d[-7:] for d in looked[1]) == ["month=2", "month=3"]
    assert sorted((r["month"], r["DIAG_PRINC"], r["MUNIC_RES"]) for r in more.where("state = 'SP'").collect()) == [
        (1, "F00", "1"), (1, "G30", "2"), (2, "F01", "9"), (2, "F02", "8"), (3, "F03", "3"),
    ]
    assert spark.read.parquet(ledger).count() == 5
    assert sorted(map(str, landing.read_admissions(spark, landed).collect())) == sorted(map(str, more.collect()))


def test_many_directories_take_a_few_jobs(spark, tmp_path):
    """Twelve months of one type, twelve of another: jobs grow with the changes of type, not with directories."""
    root = tmp_path / "l"
    for m in range(24):
        path = root / "state=SP" / f"year={2023 + m // 12}" / f"month={m % 12 + 1}"
        path.mkdir(parents=True)
        column = pa.array([m], pa.int64()) if m < 12 else pa.array([str(m)])
        extra = {"CNES": ["c"]} if m % 2 else {}
        pq.write_table(pa.table({"DIAG_PRINC": [f"F{m:02}"], "IDADE": column, **extra}), path / "a.parquet")
    df, started = jobs_of(spark, lambda: landing.read_admissions(spark, str(root)))
    assert started <= 8
    assert sorted((r["DIAG_PRINC"], r["IDADE"], r["CNES"]) for r in df.collect()) == [(f"F{m:02}", str(m), "c" if m % 2 else None) for m in range(24)]
    assert len(landing._kinds(spark, str(root), {}, "parquet", None)) == 2


def test_compressed_csv_headers(spark, tmp_path):
    path = tmp_path / "state=SP" / "year=2024" / "month=1"
    path.mkdir(parents=True)
    with gzip.open(path / "a.csv.gz", "wt") as out:
        out.write('IDADE,"DIAG_PRINC"\n81,F00\n')
    (tmp_path / "state=SP" / "year=2024" / "month=2").mkdir()
    (tmp_path / "state=SP" / "year=2024" / "month=2" / "a.csv").write_text("﻿DIAG_PRINC\nF01\n")
    got = landing.read_admissions(spark, str(tmp_path), file_format="csv", ledger=str(tmp_path / "_ledger")).collect()
    assert sorted((r["DIAG_PRINC"], r["IDADE"], r["month"]) for r in got) == [("F00", "81", 1), ("F01", None, 2)]
