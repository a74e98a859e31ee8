"""Commands: validate, compile, index, slice, export, inspect, evaluate. Exit codes: 0 done, 1 found errors, 2 misused."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from stepweave.operators import evaluate
from stepweave.operators import index as X
from stepweave.plans import compile as C
from stepweave.session import local_session
from stepweave.sources import sinks
from stepweave.sources.adapters import directory, probe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("stepweave")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for flags, options in args:
            c.add_argument(*flags, **options)

    source = (("source",), {}), (("--format",), {"default": "parquet"})
    command("ingest", *source, (("out",), {}))
    command("validate", *source, (("--max-episodes",), {"type": int}), (("--config",), {}))
    command("compile", *source, (("out",), {}), (("--config",), {}), (("--selector",), {}), (("--fail-fast",), {"action": "store_true"}))
    command("index", *source, (("out",), {}))
    command("slice", (("dataset",), {}), (("out",), {}), (("--where",), {"required": True}), (("--limit",), {"type": int}))
    command("export", *source, (("out",), {}), (("--record-format",), {"default": "parquet"}))
    command("inspect", (("dataset",), {}))
    command("evaluate", (("results",), {}), (("out",), {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or local_session()
    if a.command in ("validate", "compile", "ingest", "index", "export"):
        steps = directory(spark, a.source, a.format)
    if a.command == "ingest":
        steps.write.mode("overwrite").parquet(a.out)
    elif a.command in ("validate", "compile"):
        c = C.Compiler("dataset", fail_fast=getattr(a, "fail_fast", False), transforms=C.from_config(C.load_config(a.config)) if a.config else [])
        report = c.validate_only(steps, spark, a.max_episodes)[1].first().asDict() if a.command == "validate" else c.compile(steps, spark, a.out, a.selector).report
        print(json.dumps(report))
        return int(report["error_findings"] > 0)
    elif a.command == "index":
        sinks.write_index(X.build(steps), a.out)
    elif a.command == "slice":
        chosen = X.where_sql(X.read(spark, sinks.Layout(a.dataset).index), a.where, a.limit)
        sinks.write_index(chosen, a.out)
    elif a.command == "export":
        sinks.write_nested(steps, probe(steps, "dataset"), a.out, format=a.record_format)
    elif a.command == "inspect":
        print(json.dumps(sinks.card(X.read(spark, sinks.Layout(a.dataset).index)).first().asDict()))
    elif a.command == "evaluate":
        evaluate.save(spark.read.parquet(a.results), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
