"""``python -m pepspark.cli CONFIG``: the workflow of a YAML configuration."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pepspark.plans.workflow import run_search
from pepspark.sources.sinks import summary_text


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pepspark", description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--log-level", default="WARN")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("pepspark").getOrCreate()
    spark.sparkContext.setLogLevel(given.log_level)
    print(summary_text(run_search(spark, given.config)["summary"]))


if __name__ == "__main__":
    main()
