"""Command line: ``python -m lexivault list | sql NAME | plan NAME | run NAME``.

``run`` is a dry run unless ``--apply`` is given: it shows the schema and the plan and writes nothing. With ``--apply`` the result is
written to ``--out`` as a whole, marked as done, and left alone by later runs of the same query over the same
data unless ``--force`` is given. Further queries come from modules named with ``--module``, which have a function ``queries``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from importlib import import_module

from pyspark.sql import SparkSession

from lexivault.plans import registry
from lexivault.runtime import scratch, session
from lexivault.sources import files


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexivault", description="Run queries over a folder of tables.")
    top.add_argument("--module", action="append", default=[], help="a module with further queries")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    sql = commands.add_parser("sql", help="the SQL of a query, where it has one")
    sql.add_argument("name")
    plan = commands.add_parser("plan", help="how Spark would run a query")
    run = commands.add_parser("run", help="run a query")
    for p in (plan, run):
        p.add_argument("name")
        p.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", help="where the result goes")
    run.add_argument("--format", choices=("parquet", "json", "csv", "summary"), default="parquet", help="summary: one JSON file for a small result")
    run.add_argument("--apply", action="store_true", help="write; without it only the plan is shown")
    run.add_argument("--force", action="store_true", help="write even if the result is marked as done")
    return top


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 2 for an unknown query or a missing --out."""
    options = _arguments().parse_args(args)
    modules = [registry, *map(import_module, options.module)]
    queries = {name: run for m in modules for name, run in m.queries().items()}
    if options.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if options.name not in queries:
        print(f"no query {options.name}", file=sys.stderr)
        return 2
    if options.command == "sql":
        print({name: text for m in modules for name, text in m.oracle_sql().items()}.get(options.name, "-- no SQL for this query"))
        return 0
    spark = spark or session(f"lexivault {options.name}")
    apply = options.command == "run" and options.apply
    if apply and not options.out:
        print("--apply needs --out", file=sys.stderr)
        return 2
    facts = {"query": options.name, "data": options.data, "format": options.format if options.command == "run" else ""}
    if apply and not options.force and files.is_done(spark, options.out, **facts):
        print(f"{options.out} is done")
        return 0
    with scratch(spark):
        df = queries[options.name](spark, options.data)
        if not apply:
            df.printSchema()
            df.explain("formatted")
            return 0
        if options.format == "summary":
            files.write_summary(df, options.out)
        else:
            df.write.mode("overwrite").format(options.format).options(**({"header": "true"} if options.format == "csv" else {})).save(options.out)
        files.write_done(spark, options.out, **facts)
    print(f"{options.out} written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
