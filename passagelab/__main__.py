"""Command line: ``python -m passagelab run|prepare|validate|crosscheck|lineage|list PATH``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import gaps
from .plans import config, pipeline, storage
from .shipping import ship


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="passagelab")
    parser.add_argument("command", choices=("run", "prepare", "validate", "crosscheck", "lineage", "list"))
    parser.add_argument("path", help="a configuration; for lineage a collection, for list a folder of them")
    parser.add_argument("--top", type=int, default=10, help="gaps that prepare shows")
    parser.add_argument("--every", type=int, default=10, help="crosscheck compares every so many-th threshold")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("passagelab").getOrCreate()
    ship(spark)
    if a.command == "list":
        for row in storage.list_collections(spark, a.path):
            print(json.dumps(row))
        return 0
    if a.command == "lineage":
        print("\n".join(pipeline.lineage(spark, a.path)))
        return 0
    settings = config.load_settings(a.path)
    if a.command == "run":
        print(json.dumps(vars(pipeline.generate(spark, settings)), default=str))
        return 0
    if a.command == "prepare":
        p = pipeline.prepare_series(spark, settings)
        gaps.describe(p.series, p.gaps, p.digits).show(truncate=False)
        gaps.gap_table(p.gaps).limit(a.top).show(truncate=False)
        print(json.dumps({"digits": p.digits, "steps": list(p.record.steps)}))
        return 0
    equal, rows = pipeline.crosscheck(spark, settings, a.every) if a.command == "crosscheck" else pipeline.validate_strategies(spark, settings)
    for row in rows:
        print(json.dumps(row))
    return 0 if equal else 1


if __name__ == "__main__":
    sys.exit(main())
