"""python -m veldspar process|entities|pii INPUT OUTPUT [--jurisdiction NG]: parquet documents in, parquet out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veldspar.operators import entities
from veldspar.plans.process import Options, process


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veldspar", description=__doc__)
    parser.add_argument("job", choices=("process", "entities", "pii"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--jurisdiction")
    parser.add_argument("--text", default="text")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("veldspar").getOrCreate()
    docs = spark.read.parquet(given.input)
    jobs = {
        "process": lambda: process(docs, Options(jurisdiction=given.jurisdiction), given.text),
        "entities": lambda: entities.detect(docs, given.text),
        "pii": lambda: entities.personal_data(docs, given.text),
    }
    jobs[given.job]().write.mode("overwrite").parquet(given.output)


if __name__ == "__main__":
    main()
