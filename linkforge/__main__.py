"""Command line: ``python -m linkforge ingest|deploy|query ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from linkforge import queries, queries_state
from linkforge.operators.schema import load_schema
from linkforge.plans import publish
from linkforge.profile import DEFAULT, Profile
from linkforge.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkforge")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="merge a year's listing with its caches and write the outputs")
    for name in ("listing", "verification", "archive", "images", "collector", "identity", "out", "schema"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--year", type=int, required=True)
    one.add_argument("--extensions", default="", help="further columns, separated by commas")
    one.add_argument("--profile")
    two = sub.add_parser("deploy", help="package the rows of an upload that are ready")
    for name in ("upload", "out", "schema"):
        two.add_argument(f"--{name}", required=True)
    two.add_argument("--year", type=int, required=True)
    two.add_argument("--force", action="store_true")
    three = sub.add_parser("query", help="run a registered query over a folder of tables")
    three.add_argument("name")
    three.add_argument("folder")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkforge").getOrCreate()
    if a.command == "ingest":
        p = Profile.load(a.profile) if a.profile else DEFAULT
        caches = {n: getattr(a, n) for n in ("verification", "archive", "images", "collector", "identity")}
        print(json.dumps(publish.run_year(spark, a.listing, a.year, caches, a.out, list(load_schema(a.schema).names), [x for x in a.extensions.split(",") if x], p)))
    elif a.command == "deploy":
        print(json.dumps(publish.deploy(readers.read_csv(spark, a.upload).na.fill(""), a.out, load_schema(a.schema), a.year, a.force)))
    else:
        (queries.QUERIES | queries_state.QUERIES)[a.name](spark, a.folder).show(50, False)


if __name__ == "__main__":
    main()
