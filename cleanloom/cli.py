"""Command line: read a file, clean it by a preset, write CSV and a JSON report."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from cleanloom.plans import pipeline
from cleanloom.sources import readers


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Clean a table")
    p.add_argument("-i", "--input", default="data.csv", help="file to read")
    p.add_argument("-o", "--output", help="CSV file to write (default: clean_<input>)")
    p.add_argument("--parts", action="store_true", help="write a folder of parts, for large results")
    p.add_argument("-p", "--preset", choices=sorted(pipeline.PRESETS), default="default")
    p.add_argument("-r", "--report", help="JSON report (default: cleaning_report_<input>.json)")
    args = p.parse_args(argv)
    folder, name = os.path.split(args.input)
    args.output = args.output or os.path.join(folder, f"clean_{name}")
    args.report = args.report or os.path.join(folder, f"cleaning_report_{name}.json")
    return args


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("cleanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    data = readers.read(spark, args.input)
    made = pipeline.from_preset(args.preset, report="full", keep="table")
    result = made.run(data)
    readers.write_csv(result, args.output, single=not args.parts)
    made.report.to_json(args.report)
    for line in readers.preview(result):
        print(line)
    made.report.print_summary()
    made.release(spark)
    return 0
