"""Joins of payments with one row per key: averages, home cities, expected phone numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.skew import BROADCAST_KEYS

# A key with at most this many rows is left to an ordinary shuffle join.
JOIN_ROWS = 1_000_000


def join_by_key(
    df: DataFrame, stats: DataFrame, key: str, rows: str, join_rows: int = JOIN_ROWS
) -> DataFrame:
    """Left join with a table of one row per key that says how many ``rows`` the key has.

    The rows of a crowded key would all meet in one task, so those keys are broadcast and their
    rows stay where they are. A key is crowded above ``join_rows`` rows and a 10,000th of the
    table, so at most 10,000 keys can be.
    """
    slim = stats.drop(rows)
    total, largest = stats.agg(F.sum(rows), F.max(rows)).first()
    limit = max(join_rows, (total or 0) // BROADCAST_KEYS)
    if (largest or 0) <= limit:
        return df.join(slim, key, "left")
    crowded = F.broadcast(stats.where(F.col(rows) > limit).drop(rows))
    calm = df.join(crowded.select(key), key, "left_anti").join(slim, key, "left")
    return calm.unionByName(df.join(crowded, key))


def lookup(
    df: DataFrame, dimension: DataFrame, key: str, base: DataFrame | None = None
) -> DataFrame:
    """Left join with a dimension; a key the dimension lacks gets nulls.

    The dimension grows with the number of keys, so nothing is forced: a small one is broadcast
    by the planner. Rows per key are counted in ``base``, the same rows before further work.
    """
    counts = (base or df).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return join_by_key(df, counts.join(dimension, key, "left"), key, "_rows")


def group_mean(df: DataFrame, key: str = "customer_id", value: str = "amount") -> DataFrame:
    """The mean and the number of rows of each group."""
    return df.groupBy(key).agg(
        F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("_rows")
    )


def with_group_mean(df: DataFrame, key: str = "customer_id", value: str = "amount") -> DataFrame:
    """Add the mean of a group to each of its rows."""
    return join_by_key(df, group_mean(df, key, value), key, "_rows")


def first_transfer(df: DataFrame) -> DataFrame:
    """When each customer first paid each recipient."""
    return df.groupBy("customer_id", "recipient_entity").agg(
        F.min("timestamp").alias("first_timestamp")
    )
