"""The Spark session of the jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def job_session(name: str) -> SparkSession:
    """A session with the settings the operators are laid out for.

    Master, memory and the checkpoint folder come from spark-submit. Joins have to be partitioned
    by all of their keys: by the customer alone, a crowded one would be in one task again.
    """
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "true")
        .getOrCreate()
    )
