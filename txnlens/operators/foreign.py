"""Payments to recipients in another country than the customer's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.joins import JOIN_ROWS, lookup
from txnlens.operators.skew import BROADCAST_KEYS, stage

KEY = "recipient_entity"


def periods(recipients: DataFrame) -> DataFrame:
    """(recipient_entity, recipient_country, valid_from, valid_to) from (recipient_entity, country, valid_from).

    A country holds until the recipient's next one; of two from the same time the first by name counts.
    """
    single = recipients.groupBy(KEY, "valid_from").agg(F.min("country").alias("recipient_country"))
    following = F.lead("valid_from").over(Window.partitionBy(KEY).orderBy("valid_from"))
    return single.withColumn("valid_to", following)


def salts(txn: DataFrame, join_rows: int = JOIN_ROWS) -> DataFrame:
    """(recipient_entity, _salts) of recipients with so many payments that one task shouldn't hold them.

    At most ``BROADCAST_KEYS``: each has more than that part of all payments to such recipients.
    """
    counts = txn.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > join_rows)
    crowded = stage(counts, "crowded_recipients")
    total = crowded.agg(F.sum("_rows")).first()[0] or 0
    limit = max(join_rows, total // BROADCAST_KEYS)
    return crowded.where(F.col("_rows") > limit).select(KEY, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts"))


def recipient_country(txn: DataFrame, recipients: DataFrame, join_rows: int = JOIN_ROWS) -> DataFrame:
    """Add ``recipient_country`` at the time of each payment; null if none is known.

    Payments are joined by recipient and salt. A merchant's payments have as many salts as tasks are needed for
    them, by the payment's hash, and its periods are repeated for each salt.
    """
    crowded = F.broadcast(salts(txn, join_rows))
    salted = (
        txn.join(crowded, KEY, "left")
        .withColumn("_salt", F.pmod(F.xxhash64("transaction_id"), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    places = periods(recipients).join(crowded, KEY, "left").withColumn("_place_salt", F.explode(every)).drop("_salts")
    places = places.withColumnRenamed(KEY, "_place")
    at = F.col("timestamp")
    holds = (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    same = (F.col(KEY) == F.col("_place")) & (F.col("_salt") == F.col("_place_salt"))
    return salted.join(places.hint("merge"), same & holds, "left").drop(
        "_salt", "_place", "_place_salt", "valid_from", "valid_to"
    )


def foreign_recipient(
    txn: DataFrame, customers: DataFrame, recipients: DataFrame, join_rows: int = JOIN_ROWS
) -> DataFrame:
    """Add both countries and ``is_foreign_recipient``: 1 if both are known and differ, else 0.

    ``customers`` has a row (customer_id, customer_country) for each customer.
    """
    placed = recipient_country(lookup(txn, customers, "customer_id", txn), recipients, join_rows)
    foreign = F.col("customer_country") != F.col("recipient_country")
    return placed.withColumn("is_foreign_recipient", F.coalesce(foreign, F.lit(False)).cast("int"))
