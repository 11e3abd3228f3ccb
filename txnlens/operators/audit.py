"""What a shift over the whole sorted table would have carried from one recipient's payments to the next's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.calendar import micros
from txnlens.operators.skew import stage

GROUP = ["customer_id", "recipient_entity"]


def last_rolling(txn: DataFrame, rows: int = 30) -> DataFrame:
    """Mean and sample deviation of the last ``rows`` payments of each customer and recipient, and the first one.

    Every task keeps no more than ``rows`` payments of a group before the shuffle, so a group may be of any size.
    """
    timed = txn.select(*GROUP, "transaction_id", "amount", micros().alias("_us"))
    latest = Window.partitionBy(*GROUP).orderBy(F.desc("_us"), F.desc("transaction_id"))
    rolled = (
        timed.withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= rows)
        .groupBy(*GROUP)
        .agg(F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std"))
    )
    first = timed.groupBy(*GROUP).agg(F.min(F.struct("_us", "transaction_id")).alias("_first"))
    return rolled.join(first, GROUP).select(
        *GROUP, "mean", "std", F.col("_first.transaction_id").alias("transaction_id")
    )


def shift_audit(txn: DataFrame, rows: int = 30, parts: int | None = None) -> DataFrame:
    """First payments to a recipient that a plain shift gives the values of another group.

    In the order of customer and recipient each group's last rolling values move on to the next group, whose
    first payment should have none. ``shifted_mean`` and ``shifted_std`` are those values, ``from_customer`` and
    ``from_recipient`` say whose they are. Payments that get no mean are left out.

    Groups are dealt in ranges of that order to ``parts`` tasks (the session's number if None); between ranges
    only the last group of each moves, a row for each range.
    """
    spark = txn.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = last_rolling(txn, rows).repartitionByRange(parts, *GROUP)
    groups = stage(ranged.withColumn("_part", F.spark_partition_id()), "recipient_groups")
    carried = F.struct(*GROUP, "mean", "std")
    ends = groups.groupBy("_part").agg(F.max(carried).alias("_end"))
    earlier = F.lag("_end").over(Window.orderBy("_part"))  # one row for each range
    ends = ends.select("_part", earlier.alias("_end"))
    inside = F.lag(carried).over(Window.partitionBy("_part").orderBy(*GROUP))
    return (
        groups.withColumn("_inside", inside)
        .join(F.broadcast(ends), "_part")
        .withColumn("_from", F.coalesce("_inside", "_end"))
        .where("_from.mean IS NOT NULL")
        .select(
            *GROUP,
            "transaction_id",
            F.col("_from.customer_id").alias("from_customer"),
            F.col("_from.recipient_entity").alias("from_recipient"),
            F.col("_from.mean").alias("shifted_mean"),
            F.col("_from.std").alias("shifted_std"),
        )
    )
