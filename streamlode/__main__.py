"""Run the experiment grid over header CSV files and append a result line for each configuration that has none yet.

python -m streamlode DATA.csv --code 11 --out results [--runs 5] [--first]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.experiment import CODES, grid, run_grid
from .sources.observations import DatasetSpec, read_csv, read_metadata


def main(arguments: list[str] | None = None) -> list[dict]:
    ask = argparse.ArgumentParser(prog="streamlode")
    ask.add_argument("data")
    ask.add_argument("--code", type=int, choices=sorted(CODES), default=11)
    ask.add_argument("--out", required=True)
    ask.add_argument("--runs", type=int, default=5)
    ask.add_argument("--first", action="store_true", help="the first configuration of the grid alone")
    given = ask.parse_args(arguments)
    spark = SparkSession.builder.appName("streamlode").getOrCreate()
    about, (algorithm, variant) = read_metadata(spark, given.data).first(), CODES[given.code]
    spec = DatasetSpec(num_features=about["num_features"], num_classes=about["num_classes"], num_values=1000 if algorithm == "bayes" else 11)
    obs = read_csv(spark, given.data, spec.num_features, "double" if algorithm == "kmeans" else "int").persist()
    made = run_grid(spark, obs, spec, given.code, given.out, given.runs, grid(algorithm, spec, variant)[:1] if given.first else None)
    obs.unpersist()
    return made


if __name__ == "__main__":
    main()
