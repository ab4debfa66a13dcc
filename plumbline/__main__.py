"""Commands: ``python -m plumbline list | query | sources | run | eda``; -h tells their arguments."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.operators import eda, mlops
from plumbline.plans import payloads as _payloads  # noqa: F401 - registers itself
from plumbline.plans import program, registry
from plumbline.plans import queries as _registered  # noqa: F401 - registers itself
from plumbline.sources import ingest


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    query = commands.add_parser("query", help="write a query's rows as Parquet")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("tables")
    query.add_argument("out")
    sources = commands.add_parser("sources", help="the registered sources with their rules, one JSON line each")
    sources.add_argument("--file", default=str(ingest.SOURCES))
    run = commands.add_parser("run", help="landed payloads to a registered, evaluated model")
    run.add_argument("landing")
    run.add_argument("registry")
    run.add_argument("--features", nargs="+", required=True)
    run.add_argument("--through", type=int, required=True)
    run.add_argument("--out")
    run.add_argument("--no-pick", action="store_true")
    report = commands.add_parser("eda", help="a Markdown report on a Parquet table")
    report.add_argument("table")
    report.add_argument("out")
    report.add_argument("--features", nargs="+", required=True)
    report.add_argument("--target", required=True)
    report.add_argument("--group", required=True)
    report.add_argument("--edges", nargs="+", type=float, required=True, help="inner edges of the target's bands")
    report.add_argument("--labels", nargs="+", required=True, help="names of the bands, one more than edges")
    return parser.parse_args(words)


def main(words: list[str] | None = None) -> None:
    a = arguments(words)
    if a.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    if a.command == "sources":
        for source in ingest.load_sources(a.file).values():
            print(json.dumps(vars(source), default=str))
        return
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if a.command == "query":
        registry.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.command == "run":
        print(json.dumps(program.run(spark, a.landing, a.features, a.through, mlops.Registry(a.registry), a.out, not a.no_pick), default=str))
    else:
        Path(a.out).write_text(eda.report(spark.read.parquet(a.table), a.features, a.target, a.group, a.edges, a.labels))


if __name__ == "__main__":
    main(sys.argv[1:])
