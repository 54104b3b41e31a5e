"""Command line: fit a model document to a CSV file, and summarise one.

    python -m statloom fit -m prior.json -d data.csv -o posterior.json [-c y,x1,x2]
    python -m statloom summary -m posterior.json -o summary.csv

Input paths are whatever Spark reads; the outputs, a few lines, are files of the machine that runs the command.
"""

from __future__ import annotations

import argparse
import csv
from pathlib import Path

from pyspark.sql import SparkSession

from statloom.sources.documents import read_document


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="statloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="the posterior of a model given the rows of a CSV file with a header")
    fit.add_argument("-d", "--data", required=True)
    fit.add_argument("-c", "--columns", help="names, the outcome first; all columns of the file if left out")
    summary = commands.add_parser("summary", help="parameters with mean, variance and credible interval")
    summary.add_argument("--mass", type=float, default=0.95)
    for c in (fit, summary):
        c.add_argument("-m", "--model", required=True)
        c.add_argument("-o", "--output", required=True)
    found = parser.parse_args(args)
    spark = SparkSession.builder.appName("statloom").getOrCreate()
    model = read_document(spark, found.model)
    if found.command == "fit":
        rows = spark.read.csv(found.data, header=True, inferSchema=True)
        columns = found.columns.split(",") if found.columns else rows.columns
        Path(found.output).write_text(model.posterior(rows, columns).to_json() + "\n")
    else:
        with open(found.output, "w", newline="") as out:
            table = csv.DictWriter(out, ["parameter", "mean", "variance", "low", "high"])
            table.writeheader()
            table.writerows(model.summary(found.mass))


if __name__ == "__main__":
    main()
