"""python -m perfloom: regressions and trends of a history file, statistics of records and models, or a named query."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import history, reports
from .plans import queries
from .sources import readers, sinks


def command_line() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="perfloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("regression", "compare each snapshot with the one before"), ("trend", "trends of the last days"), ("report", "a text about the history")):
        s = sub.add_parser(name, help=what)
        s.add_argument("history", help="JSON file of snapshots")
        s.add_argument("--days", type=int, default=7)
    s = sub.add_parser("stats", help="adoption by model")
    s.add_argument("history", help="JSON file of model histories")
    s = sub.add_parser("export", help="records as CSV")
    s.add_argument("records", help="JSON file of records")
    s.add_argument("out", help="folder of the CSV files")
    s = sub.add_parser("query", help="a named query over a folder of tables")
    s.add_argument("name", choices=sorted(queries.QUERIES))
    s.add_argument("folder")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    if args.command == "query":
        return queries.QUERIES[args.name](spark, args.folder)
    if args.command == "stats":
        h = readers.model_history(spark, args.history)
        return h.withColumn("accuracy", F.try_divide("adopted", "total"))
    if args.command == "export":
        r = readers.record_store(spark, args.records)
        sinks.export_csv(r, args.out)
        return None
    s = readers.snapshot_history(spark, args.history)
    if args.command == "trend":
        return history.trend_first_last(s, ["qps", "avg_latency", "p99_latency"], args.days)
    return reports.regression_report(s) if args.command == "report" else history.compare_previous(s)


def main(argv: list[str] | None = None) -> None:
    args = command_line().parse_args(argv)
    spark = SparkSession.builder.appName("perfloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if (out := run(spark, args)) is not None:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
