"""Exact-size samples and splits without sorting the table.

A row is taken if its hash is among the smallest n of its stratum. The n-th smallest hash is found
by counting rows per range of hash values, which leaves one narrow range to be looked at closely;
after that every row decides for itself by comparing with the cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.constants import ANOMALY_SHARE, LABEL, TEST_SHARE
from txnlens.functions.draws import hash_number

# 48-bit hashes in 2^20 ranges: a millionth of the rows is ranked.
_RANGE_BITS = 28


def mark_smallest(
    df: DataFrame,
    flag: str,
    wanted: Callable[[Column], Column],
    seed: str,
    key: str = "transaction_id",
    stratum: Column | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Flag exactly ``wanted(rows of the stratum)`` rows, chosen by hash.

    ``stratum`` must have few values, like a 0/1 label: one row for each is broadcast. ``base``
    holds the same keys with less work behind them; the cut is found in it.
    """
    marks = {
        "_stratum": F.lit(0) if stratum is None else stratum,
        "_hash": hash_number(seed, key),
    }
    slim = (
        (base or df)
        .withColumns(marks)
        .select("_stratum", "_hash", key, F.shiftright("_hash", _RANGE_BITS).alias("_range"))
    )
    group = Window.partitionBy("_stratum")
    counts = (
        slim.groupBy("_stratum", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_upto": F.sum("_n").over(group.orderBy("_range")),
                "_wanted": wanted(F.sum("_n").over(group)).cast("bigint"),
            }
        )
        .where("_upto >= _wanted and _upto - _n < _wanted")
        .select("_stratum", "_range", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    rank = F.row_number().over(group.orderBy("_hash", key))
    cut = (
        slim.join(F.broadcast(counts), ["_stratum", "_range"])
        .withColumn("_rank", rank)
        .where("_rank = _rest")
        .select("_stratum", F.struct("_hash", F.col(key)).alias("_cut"))
    )
    inside = F.struct("_hash", F.col(key)) <= F.col("_cut")
    return (
        df.withColumns(marks)
        .join(F.broadcast(cut), "_stratum", "left")
        .withColumn(flag, F.coalesce(inside, F.lit(False)))
        .drop("_stratum", "_hash", "_cut")
    )


def mark_share(
    df: DataFrame,
    flag: str,
    seed: str,
    share: float = ANOMALY_SHARE,
    base: DataFrame | None = None,
) -> DataFrame:
    """Flag a fixed share of the rows, rounded down."""
    return mark_smallest(df, flag, lambda n: F.floor(n * share), seed, base=base)


def sample_rows(df: DataFrame, seed: str = "sample", share: float = ANOMALY_SHARE) -> DataFrame:
    """A sample without replacement of exactly the given share of rows, rounded down."""
    return mark_share(df, "_sampled", seed, share).where("_sampled").drop("_sampled")


def stratified_split(
    df: DataFrame, seed: str = "split-42", test_share: float = TEST_SHARE, label: str = LABEL
) -> DataFrame:
    """Add ``is_test``: the given share of each label's rows, to the nearest row."""
    return mark_smallest(
        df, "is_test", lambda n: F.floor(n * test_share + 0.5), seed, stratum=F.col(label)
    )
