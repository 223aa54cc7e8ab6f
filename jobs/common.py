"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("epochloom.jobs")


def packaged(name: str) -> dict:
    """The config file beside the job."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), name)) as f:
        return json.load(f)


def read_config(spark: SparkSession, path: str | None, name: str) -> dict:
    """A config file from any store Spark reads, else the one beside the job."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else packaged(name)


def parquet_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a job writes itself; no rows before its first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(job: str, paths: list[str], run: Callable[..., dict], config: str) -> None:
    """Parse the command line, make a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file; by default the one beside the job")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        settings = read_config(spark, args.pop("config"), config)
        print(json.dumps(run(spark, *[args[p] for p in paths], settings), sort_keys=True))
    finally:
        spark.stop()
