"""Command line: python -m docsluice.cli report|config|query ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from docsluice import config
from docsluice.operators import quality, report
from docsluice.plans import tables as t
from docsluice.plans.queries import QUERIES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docsluice")
    verbs = parser.add_subparsers(dest="verb", required=True)
    r = verbs.add_parser("report", help="corpus report over a folder of tables")
    r.add_argument("folder")
    r.add_argument("--scope")
    r.add_argument("--json", action="store_true")
    c = verbs.add_parser("config", help="settings and where each is from")
    c.add_argument("--seed", choices=["do-nothing", "merge"], help="print SQL that seeds the config table")
    q = verbs.add_parser("query", help="run a query of the catalogue")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("folder")
    args = parser.parse_args(argv)
    if args.verb == "config":
        tree, source = config.load()
        print(config.seed_sql(tree, args.seed) if args.seed else json.dumps({"settings": tree, "source": source}, indent=2, ensure_ascii=False))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "query":
        QUERIES[args.name](spark, args.folder).show(20, truncate=60)
        return 0
    chunks = t.chunks(spark, args.folder)
    findings = quality.chunk_findings(chunks).selectExpr("*", "false as resolved")
    made = report.build_report(t.files(spark, args.folder), t.metrics(spark, args.folder), chunks, findings, args.scope)
    print(json.dumps(made, default=str, ensure_ascii=False) if args.json else report.render(made))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
