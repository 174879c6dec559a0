"""Command line for the batch jobs: ``python -m wardcast <job> …`` or through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from wardcast import DEMENTIA_COHORT, DEMENTIA_PROJECTION, DEMENTIA_TERRITORY
from wardcast.plans import jobs
from wardcast.presets import BRAZIL_60_PLUS, CONDITION_LABELS
from wardcast.schemas import ANCHORS, COHORT, COMORBIDITY, INDICATORS, TERRITORY, projection_table
from wardcast.session import GB, sized
from wardcast.sources import landing, tables

REGION_ANCHORS = T.StructType([T.StructField("region", T.StringType()), *ANCHORS.fields])
REGION_NAMES = T.StructType([T.StructField("region", T.StringType()), T.StructField("name", T.StringType())])


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="wardcast")
    commands = main.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.add_argument("--input-gb", type=int, help="size of the input; without it, that of the files it names")
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    for name in ("cohort", "rankings"):
        sub = job(name, "landing", "cohort")
        sub.add_argument("--format", default="parquet", choices=["parquet", "csv"])
        sub.add_argument("--states", nargs="*", default=[])
        sub.add_argument("--years", nargs="*", type=int, default=[])
        sub.add_argument("--months", nargs="*", type=int, default=[])
        sub.add_argument("--ledger", help="table of what is known of the landing files' columns; made if it is not there")
        sub.add_argument("--whole-state", action="store_true", help="do not restrict to the preset's city")
        if name == "cohort":
            sub.add_argument("--secondary", action="store_true", help="keep rows where either diagnosis matches")
        else:
            for path in ("projection", "names", "territory", "comorbidity"):
                sub.add_argument(f"--{path}", required=True)
    states = job("states", "cohort", "out")
    for name, kind in (("states", str), ("years", int), ("months", int)):
        states.add_argument(f"--{name}", nargs="*", type=kind, default=[], help="of the landing files; default: all")
    job("history", "cohort", "out").add_argument("--from-states", help="merge these states instead of reading the cohort")
    projection = job("projection", "out")
    projection.add_argument("--anchors", help="CSV of region, year, pop_millions; default: national")
    projection.add_argument("--cohort", help="take rate and cost per admission from this cohort's base year")
    load = job("load", "cohort", "history", "projection", "territory", "comorbidity")
    load.add_argument("--prefix", default="")
    job("dashboard", "out").add_argument("--prefix", default="")
    return main


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    read = {"cohort": ["landing"], "rankings": ["landing", "cohort"], "history": ["cohort"], "states": ["cohort"], "projection": ["cohort"], "load": ["cohort"]}
    paths = [getattr(args, name) for name in read.get(args.job, []) if getattr(args, name)]
    sized(spark, *paths, input_bytes=args.input_gb * GB if args.input_gb else None)
    if args.job in ("cohort", "rankings"):
        raw = jobs.read_landing(spark, args.landing, args.states, args.years, args.months, args.format, args.ledger)
        spec = DEMENTIA_COHORT
        if args.whole_state:
            spec = type(spec)(**{**spec.__dict__, "region": None})
    if args.job == "cohort":
        written = jobs.build_cohort(raw, args.cohort, spec, secondary=args.secondary)
        for report in jobs.cohort_report(raw, written, spec, secondary=args.secondary):
            report.show(truncate=False)
    elif args.job == "states":
        jobs.build_states(spark, args.cohort, args.out, args.states, args.years, args.months)
    elif args.job == "history":
        history = jobs.build_history(spark, args.cohort, args.out, args.from_states)
        print("no cohort yet; nothing written" if history is None else f"{history.count()} years")
    elif args.job == "projection":
        if args.anchors:
            anchors, keys = tables.read_csv(spark, args.anchors, REGION_ANCHORS), ["region"]
        else:
            anchors, keys = landing.inline_table(spark, BRAZIL_60_PLUS, ANCHORS), []
        cohort = jobs.read_cohort(spark, args.cohort).withColumnRenamed("state", "region") if args.cohort else None
        jobs.build_projection(anchors, args.out, DEMENTIA_PROJECTION, keys, cohort).show(60)
    elif args.job == "rankings":
        projection = tables.read_csv(spark, args.projection, projection_table(["region"]).schema)
        names = tables.read_csv(spark, args.names, REGION_NAMES)
        jobs.build_rankings(
            raw,
            jobs.read_cohort(spark, args.cohort),
            projection,
            names,
            args.territory,
            args.comorbidity,
            spec,
            DEMENTIA_PROJECTION,
            DEMENTIA_TERRITORY,
            CONDITION_LABELS,
        )
    elif args.job == "load":
        read = landing.read_optional
        projection = read(spark, args.projection, projection_table(["region"]).schema, "csv")
        if projection is not None and "region" not in tables.csv_header(spark, args.projection):
            projection = projection.drop("region")
        counts = jobs.load_tables(
            {
                "admissions": read(spark, args.cohort, COHORT),
                "indicators": read(spark, args.history, INDICATORS, "csv"),
                "projection": projection,
                "territory": read(spark, args.territory, TERRITORY, "csv"),
                "comorbidity": read(spark, args.comorbidity, COMORBIDITY, "csv"),
            },
            args.prefix,
        )
        for name, rows in counts.items():
            print(f"{name}: {rows} rows")
    elif args.job == "dashboard":
        jobs.create_views(spark, DEMENTIA_PROJECTION, args.prefix)
        tables.write_json_sections(jobs.dashboard_frames(spark, DEMENTIA_PROJECTION, args.prefix), args.out)


if __name__ == "__main__":
    run(SparkSession.builder.appName("wardcast").getOrCreate(), parser().parse_args())
