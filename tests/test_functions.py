from __future__ import annotations

import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast import functions as W
from wardcast.spec import CohortSpec, ProjectionSpec

EDGES = (0, 59, 69, 74, 79, 84, 200)
LABELS = ("<60", "60-69", "70-74", "75-79", "80-84", "85+")


def values(df):
    return [r[0] for r in df.collect()]


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i,) for i in items], f"x {kind}").coalesce(1)


def test_bands_are_right_closed(spark):
    ages = [-1.0, 0.0, 1.0, 59.0, 59.5, 60.0, 69.0, 70.0, 74.0, 75.0, 79.0, 80.0, 84.0, 85.0, 200.0, 201.0, None]
    got = values(column(spark, ages, "double").select(W.right_closed_band(F.col("x"), EDGES, LABELS)))
    assert got == [
        None, None, "<60", "<60", "60-69", "60-69", "60-69", "70-74", "70-74", "75-79", "75-79", "80-84", "80-84",
        "85+", "85+", None, None,
    ]


ODD = ["7", " 7 ", "+7", "-7", "7.", ".5", "2.5", "1e2", "1E+2", "x", "", "NaN", "nan", "inf", "-Infinity", "1d", "1f",
       "0x10", "1e999", "1,5", "12 3", None]


def test_parse_double(spark):
    got = values(column(spark, ODD).select(W.parse_double(F.col("x"), T.StringType())))
    assert got == [7, 7, 7, -7, 7, 0.5, 2.5, 100, 100] + [None] * 13


def test_parse_whole_refuses_fractions(spark):
    got = values(column(spark, ODD).select(W.parse_whole(F.col("x"), T.StringType())))
    assert got == [7, 7, 7, -7, 7, None, None, 100, 100] + [None] * 13


def test_parse_int_rounds(spark):
    got = values(column(spark, ODD).select(W.parse_int(F.col("x"), T.StringType())))
    assert got == [7, 7, 7, -7, 7, 1, 3, 100, 100] + [None] * 13


def test_parse_decimal(spark):
    got = values(column(spark, ODD).select(W.parse_decimal(F.col("x"), T.StringType())))
    assert got == [Decimal(v) for v in ("7", "7", "7", "-7", "7", "0.5", "2.5", "100", "100")] + [None] * 13


@pytest.mark.parametrize("parse", [W.parse_double, W.parse_whole, W.parse_int, W.parse_decimal])
def test_numeric_columns_are_taken_as_they_are(spark, parse):
    df = column(spark, [1.0, float("nan"), float("inf"), None], "double")
    assert values(df.select(parse(F.col("x"), T.DoubleType()).cast("double"))) == [1.0, None, None, None]
    assert values(column(spark, [5, None], "int").select(parse(F.col("x"), T.IntegerType()).cast("int"))) == [5, None]


def test_out_of_range_is_null(spark):
    df = column(spark, ["99999999999", "1e15", "-99999999999"])
    assert values(df.select(W.parse_int(F.col("x"), T.StringType()))) == [None] * 3
    assert values(df.select(W.parse_whole(F.col("x"), T.StringType()))) == [None] * 3
    assert values(column(spark, ["12345678901234.00"]).select(W.parse_decimal(F.col("x"), T.StringType()))) == [None]


def test_prefix_test_ignores_case_and_does_not_trim(spark):
    codes = ["F009", "f001", "F03", " F00", "XF00", "F0", "g30", "G309", "G31", None, ""]
    got = values(column(spark, codes).select(W.starts_with_any(F.col("x"), ("F00", "F03", "G30"))))
    assert got == [True, True, True, False, False, False, True, True, False, None, False]


def test_prefix_with_several_letters(spark):
    codes = ["PROMO", "promo", "PrO1", "PRX", "P", "ab12x", "AB12", "aB1"]
    got = values(column(spark, codes).select(W.starts_with_any(F.col("x"), ("pro", "AB12"))))
    assert got == [True, True, True, False, False, True, True, False]


def test_region_compares_leading_digits(spark):
    codes = ["3550308", "355030", "35503", "355031", None]
    df = column(spark, codes)
    assert values(df.select(W.in_region(F.col("x"), "355030"))) == [True, True, False, False, None]
    assert values(df.select(W.in_region(F.col("x"), "35503"))) == [False, False, True, False, None]
    assert values(df.select(W.in_region(F.col("x"), "3550308"))) == [False] * 5


def test_lookup(spark):
    df = column(spark, ["1", "2", "1.0", None])
    assert values(df.select(W.lookup(F.col("x"), {"1": "one", "3": "three"}))) == ["one", None, None, None]
    assert values(df.select(W.lookup(F.col("x"), {}))) == [None] * 4


def test_half_even_and_half_up(spark):
    ties = column(spark, [8390.5, 8391.5, 0.125, 2.5, -2.5], "double")
    assert values(ties.select(W.half_even(F.col("x")))) == [8390.0, 8392.0, 0.0, 2.0, -2.0]
    assert values(ties.select(W.half_even(F.col("x"), 2)))[2] == 0.12
    money = column(spark, [Decimal("2.125"), Decimal("-2.125")], "decimal(10,3)")
    assert values(money.select(W.half_up(F.col("x"), 2))) == [Decimal("2.13"), Decimal("-2.13")]


def test_half_even_rounds_like_numpy(spark):
    rng = np.random.default_rng(7)
    costs = rng.integers(1, 200_000, 20_000) * (4000.0 * 1.0175 ** rng.integers(0, 26, 20_000))
    costs = np.append(costs, 9377 * (4000.0 * 1.0175**2))
    df = spark.createDataFrame([(float(c),) for c in costs], "x double")
    for x, cents, whole in df.select("x", W.half_even(F.col("x"), 2), W.half_even(F.col("x"))).collect():
        assert (cents, whole) == (np.round(x, 2), np.round(x))


def test_exact_mean_rounds_the_true_quotient(spark):
    rows = [(Decimal("4649844.22") if i == 0 else Decimal(0),) for i in range(92)]
    df = spark.createDataFrame(rows, "x decimal(15,2)")
    assert values(df.agg(W.exact_mean(F.col("x"), 2))) == [Decimal("50541.79")]
    assert values(df.limit(0).agg(W.exact_mean(F.col("x"), 2))) == [None]


def test_exact_ratio(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (2, 3), (1, 0), (999_999_999_999, 1_000_000_000_000)], "a long, b long")
    got = values(df.coalesce(1).select(W.exact_ratio(F.col("a"), F.col("b"), 2)))
    assert got == [Decimal("0.13"), Decimal("-0.13"), Decimal("0.67"), None, Decimal("1.00")]


def test_display_formats(spark):
    one = spark.range(1)

    def shown(c):
        return one.select(c).first()[0]

    assert shown(W.dotted_thousands(F.lit(15641))) == "15.641"
    assert shown(W.dotted_thousands(F.lit(1234567.5), 1)) == "1.234.567,5"
    assert shown(W.decimal_comma(F.lit(64.50))) == "64,5"
    assert shown(W.decimal_comma(F.lit(24.25))) == "24,25"
    assert shown(W.decimal_comma(F.lit(1e7))) == "10000000"
    assert shown(W.decimal_comma(F.lit(100.0))) == "100"
    assert shown(W.signed_percent(F.lit(115.708))) == "+116%"
    assert shown(W.signed_percent(F.lit(-2.5))) == "-2%"
    assert shown(W.code_with_description(F.lit("J18"), F.lit("Pneumonia"))) == "J18 · Pneumonia"
    assert shown(W.code_with_description(F.lit("J18"), F.lit(None).cast("string"))) == "J18"
    assert shown(W.in_millions(F.lit(Decimal("29004000.00")))) == Decimal("29.00")
    assert shown(W.in_millions(F.lit(Decimal("147854059.20")), 1)) == Decimal("147.9")


def test_specs_check_their_parameters():
    with pytest.raises(ValueError):
        CohortSpec(prefixes=())
    with pytest.raises(ValueError):
        CohortSpec(prefixes=("F00",), age_edges=(0, 10), age_labels=("a", "b"))
    with pytest.raises(ValueError):
        CohortSpec(prefixes=("F00",), age_edges=(0, 10, 10), age_labels=("a", "b"))
    assert len(CohortSpec(prefixes=("F00",), labels={str(i): "x" for i in range(1000)}).labels) == 1000
    with pytest.raises(ValueError):
        ProjectionSpec(rate=1, base_year=1, end_year=2, base_value=1, scenarios={"x": 0.0})


def test_many_prefixes_are_looked_up(spark, monkeypatch):
    from wardcast.functions import text

    prefixes = [f"{a}{i:02}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(100)] + [f"z{i:05}x" for i in range(2400)] + ["A001", "é9", "Q1r2"]
    codes = ["A00", "a001", "A0", "b99x", " A00", "", None, "Z00000x", "z00001X9", "z99999", "É9z", "é9", "q1R2", "q1r", "5", "ZZ"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    start = time.perf_counter()
    got = [r[0] for r in df.select(text.starts_with_any(F.col("code"), prefixes)).collect()]
    assert time.perf_counter() - start < 20
    assert got == [None if c is None else c.upper().startswith(tuple(p.upper() for p in prefixes)) for c in codes]
    few = [prefixes[0], "b99", "z00001x", "é9", "q1r2", "5"]
    both = []
    for limit in (0, 100):
        monkeypatch.setattr(text, "SPELLED_PREFIXES", limit)
        both.append([r[0] for r in df.select(text.starts_with_any(F.col("code"), few)).collect()])
    assert both[0] == both[1] and any(both[0])


def test_the_first_characters_of_many_prefixes_reach_the_reader(spark, tmp_path):
    from wardcast.functions import starts_with_any

    spark.createDataFrame([("F00",), ("X99",)], "code string").write.parquet(str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p")).where(starts_with_any(F.col("code"), [f"F{i:04}" for i in range(5000)] + ["F00"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(code,F)" in plan and "StringStartsWith(code,f)" in plan
    assert [r[0] for r in kept.collect()] == ["F00"]
