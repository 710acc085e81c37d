"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

HEADLINE = ("nb_predict", "nb_running_accuracy", "info_gain", "best_split", "shuffle_within_chunk", "csv_parse_int")


def main() -> None:
    from pyspark.sql import SparkSession

    from streamlode.operators import metrics
    from streamlode.plans import catalogue as c
    from streamlode.plans.experiment import Experiment

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make, runs: int = 2) -> float:
        spent = []
        for _ in range(1 + runs):  # one to warm up
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        return round(median(spent[1:]), 4)

    seconds = {}
    # scoring alone, as the baseline times it: the model is fitted beforehand
    for name, obs, spec, algorithm in (("dt", c.o.obs_orders, c.WIDE, "tree"), ("nb", c.o.obs_orders, c.INT, "bayes"), ("km", c.o.obs_vec, c.VEC, "kmeans")):
        for variant in ("naive", "oblivious", "randomized"):
            e = Experiment(obs(spark, sf_dir), spec, algorithm, variant)
            model = e.fit()
            seconds[f"score_{name}_{variant}"] = timed(lambda e=e, m=model: metrics.accuracy(e.predict(m)), 5)
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: c.QUERIES[n](spark, sf_dir))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
