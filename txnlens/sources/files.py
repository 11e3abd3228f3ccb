"""Payments from CSV or parquet files, by the jobs' ``--format``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from txnlens.schema import canonical
from txnlens.sources.csv import read_transactions


def add_input_options(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--timestamp-format", help="pattern of the times, if they are not ISO text")
    parser.add_argument(
        "--lenient", action="store_true", help="text that cannot be parsed becomes null"
    )


def load(
    spark: SparkSession,
    path: str,
    kind: str,
    strict: bool = True,
    timestamp_format: str | None = None,
) -> DataFrame:
    if kind == "csv":
        return read_transactions(spark, path, strict, timestamp_format)
    return canonical(spark.read.parquet(path), strict, timestamp_format)
