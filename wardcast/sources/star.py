"""Admissions read out of a sales star schema.

The tables given for checks hold no admissions. Order lines stand for them: one line is one
admission, the part's type is the principal diagnosis, the supplier's nation gives the region, and
orders per region and year, counted over periods of some years, stand for the population.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.presets import AGE_EDGES, AGE_LABELS
from wardcast.schemas import RAW
from wardcast.spec import CohortSpec, ProjectionSpec, TerritorySpec

STAR_COHORT = CohortSpec(
    prefixes=("PRO", "ECO", "STA"),
    labels={"PRO": "Promotional", "ECO": "Economy", "XXX": "Not sold", "STA": "Standard"},
    sex_labels={"1": "Male", "3": "Female"},
    age_edges=AGE_EDGES,
    age_labels=AGE_LABELS,
)
STAR_CITY_COHORT = replace(STAR_COHORT, region="355030")
STAR_PROJECTION = ProjectionSpec(
    rate=24.25,
    base_year=1998,
    end_year=2001,
    base_value=4000.0,
    scenarios={"a": 0.0, "b": 0.0175, "c": 0.035},
    milestones=(1995, 1998, 2001),
)
STAR_TERRITORY = TerritorySpec(
    levels=((90, "Critical"), (80, "High"), (72, "Medium-High")),
    floor_level="Medium",
    tier_one=("Critical",),
    tier_two=("High", "Medium-High"),
)
# Periods of so many years, counted from the first year of the data.
PERIOD_ORIGIN, PERIOD_YEARS = 1995, 3
DESCRIPTIONS = {
    "ECO": "Economy line",
    "LAR": "Large line",
    "MED": "Medium line",
    "PRO": "Promotional line",
    "SMA": "Small line",
}

_L, _I, _S, _D, _N = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()
SCHEMAS: dict[str, dict[str, T.DataType]] = {
    "region": {"r_regionkey": _I, "r_name": _S},
    "nation": {"n_nationkey": _I, "n_name": _S, "n_regionkey": _I},
    "customer": {"c_custkey": _L, "c_name": _S, "c_nationkey": _I, "c_acctbal": _D, "c_mktsegment": _S},
    "supplier": {"s_suppkey": _L, "s_name": _S, "s_nationkey": _I, "s_acctbal": _D},
    "part": {"p_partkey": _L, "p_name": _S, "p_brand": _S, "p_type": _S, "p_size": _I, "p_retailprice": _D},
    "orders": {
        "o_orderkey": _L,
        "o_custkey": _L,
        "o_orderstatus": _S,
        "o_totalprice": _D,
        "o_orderdate": _N,
        "o_orderpriority": _S,
    },
    "lineitem": {
        "l_orderkey": _L,
        "l_partkey": _L,
        "l_suppkey": _L,
        "l_linenumber": _I,
        "l_quantity": _D,
        "l_extendedprice": _D,
        "l_discount": _D,
        "l_tax": _D,
        "l_returnflag": _S,
        "l_linestatus": _S,
        "l_shipdate": _N,
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with its schema stated so that no file is opened while planning."""
    schema = T.StructType([T.StructField(c, t) for c, t in SCHEMAS[name].items()])
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


FIELDS = {
    "DIAG_PRINC": "p_type",
    "DIAG_SECUN": "CASE l_linenumber % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE p_brand END",
    "MUNIC_RES": "concat('35503', string(s_nationkey % 10), string(l_linenumber % 10))",
    "IDADE": "int(l_quantity * 2)",
    "SEXO": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '3' WHEN 'N' THEN '2' END",
    "DIAS_PERM": "l_linenumber",
    "VAL_TOT": "cast(l_extendedprice AS decimal(15,2))",
    "MORTE": "int(coalesce(l_linestatus = 'F', false))",
    "ANO_CMPT": "year(l_shipdate)",
    "MES_CMPT": "month(l_shipdate)",
    "CNES": "l_suppkey",
    "region": "n_regionkey",
}
_FROM_PART = {"DIAG_PRINC", "DIAG_SECUN"}
_FROM_SUPPLIER = {"MUNIC_RES", "region"}


def admissions(spark: SparkSession, sf_dir: str, fields: Sequence[str], *, text: bool = False) -> DataFrame:
    """The named landing fields of every order line, typed as in the tables or, with ``text``, as
    in landing files.

    A dimension is joined only if one of the fields needs it; being outer joins on unique keys,
    they never change the rows. Part and supplier grow with the data, so they carry no broadcast
    hint: Spark broadcasts them if they are small and otherwise shuffles, splitting hot keys at
    run time. The nation table has 25 rows at any size.
    """
    rows = table(spark, sf_dir, "lineitem")
    if _FROM_PART.intersection(fields):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if _FROM_SUPPLIER.intersection(fields):
        nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
        supplier = (
            table(spark, sf_dir, "supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select("s_suppkey", "s_nationkey", "n_regionkey")
        )
        rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    as_text = set(RAW.names) if text else set()
    return rows.selectExpr(
        *[f"string({FIELDS[name]}) AS {name}" if name in as_text else f"{FIELDS[name]} AS {name}" for name in fields]
    )


def orders_per_period(
    spark: SparkSession, sf_dir: str, keys: Sequence[str] = ("region",), origin: int = PERIOD_ORIGIN, years: int = PERIOD_YEARS
) -> DataFrame:
    """(region, year, orders, days): every order, in the period of ``years`` years that its date falls into.

    ``year`` is the period's first. ``days`` counts its days between the first and the last order of the table, so
    a period that the data covers in part has fewer. Orders without a date have no period, those of an
    unknown customer no region; both are groups of their own.

    Orders are counted per customer and period before they meet customers, so a customer with a third of
    all orders is a few rows per task by then.
    """
    day = F.col("o_orderdate").cast("date")
    period = (F.floor((F.year(day) - F.lit(origin)) / F.lit(years)) * F.lit(years) + F.lit(origin)).cast("int")
    orders = table(spark, sf_dir, "orders").withColumns({"year": period, "day": day})
    counts = [F.count(F.lit(1)).alias("orders"), F.min("day").alias("first"), F.max("day").alias("last")]
    if keys:
        nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
        counted = (
            orders.groupBy("o_custkey", "year")
            .agg(*counts)
            .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .groupBy(F.col("n_regionkey").alias("region"), "year")
            .agg(F.sum("orders").alias("orders"), F.min("first").alias("first"), F.max("last").alias("last"))
        )
    else:
        counted = orders.groupBy("year").agg(*counts)
    # One row per region and period by now.
    every = Window.partitionBy()
    begin = F.greatest(F.make_date("year", F.lit(1), F.lit(1)), F.min("first").over(every))
    end = F.least(F.make_date(F.col("year") + F.lit(years), F.lit(1), F.lit(1)), F.date_add(F.max("last").over(every), 1))
    days = F.when(F.col("year").isNotNull(), F.date_diff(end, begin))
    return counted.select(*keys, "year", "orders", days.alias("days"))


def population_anchors(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Orders per 365 days of each period, as (region, year, pop_millions): all orders of the table count."""
    rate = F.col("orders").cast("double") * F.lit(365.0) / F.col("days").cast("double")
    return orders_per_period(spark, sf_dir, keys).select(*keys, "year", rate.alias("pop_millions"))


def facility_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(facility_id, region) of every supplier."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return supplier.select(F.col("s_suppkey").cast("string").alias("facility_id"), F.col("n_regionkey").alias("region"))


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
