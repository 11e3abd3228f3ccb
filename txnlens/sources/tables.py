"""The given parquet tables as canonical transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.constants import (
    ACH,
    ANOMALY_SHARE,
    BANK_CITIES,
    CITY_POPULATION,
    FLAGS,
    TYPE_WEIGHT,
    WALLET,
)
from txnlens.functions.calendar import MINUTE
from txnlens.functions.draws import (
    account_number,
    draw,
    phone_number,
    pick,
    values_array,
    weighted_pick,
    whole,
)
from txnlens.functions.text import zero_pad
from txnlens.operators.inject import home_city

START_2024 = 1_704_067_200_000_000  # microseconds since 1970

CITIES = list(CITY_POPULATION)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _no_flags() -> list:
    return [F.lit(0).alias(flag) for flag in FLAGS]


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as payments.

    The type of payment is drawn by its weight. Transfers go to one of a few account numbers
    of the customer, everything else to the event type.
    """
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    kind = F.col("transaction_type")
    account = (
        F.when(
            kind == WALLET,
            1_000_000_000 + (F.col("user_id") * 5 + F.pmod("k", F.lit(5))) * 7919,
        )
        .when(kind == ACH, 70_000_000 + (F.col("user_id") * 3 + F.pmod("k", F.lit(3))) * 7919)
        .cast("string")
    )
    return (
        table(spark, sf_dir, "events")
        .withColumns(
            {"k": k, "transaction_type": weighted_pick(TYPE_WEIGHT, "type", "event_id")}
        )
        .withColumn("recipient_entity", F.coalesce(account, F.col("event_type")))
        .select(
            F.concat(F.lit("customer_"), zero_pad("user_id", 3)).alias("customer_id"),
            F.concat(
                F.lit("customer_"), zero_pad("user_id", 3), F.lit("-"), zero_pad("event_id", 8)
            ).alias("transaction_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            "transaction_type",
            F.col("value").alias("amount"),
            *_no_flags(),
            F.element_at(values_array(CITIES), F.pmod("k", F.lit(20)) + 1).alias("city"),
            F.when(kind == WALLET, "Person-to-Person")
            .when(kind == ACH, "Friend/Family Transfer")
            .otherwise(F.col("event_type"))
            .alias("entity_type"),
            "recipient_entity",
            F.col("recipient_entity").alias("original_recipient_entity"),
        )
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as payments: many share a customer and a day, so ties occur.

    The city is a place name made from the order status.
    """
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer_"), zero_pad("o_custkey", 3)).alias("customer_id"),
        zero_pad("o_orderkey", 12).alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit(ACH).alias("transaction_type"),
        F.col("o_totalprice").alias("amount"),
        *_no_flags(),
        F.concat(F.lit("CITY_"), F.col("o_orderstatus")).alias("city"),
        F.col("o_orderpriority").alias("entity_type"),
        F.col("o_orderpriority").alias("recipient_entity"),
        F.col("o_orderpriority").alias("original_recipient_entity"),
    )


def with_resends(txn: DataFrame, share: float = ANOMALY_SHARE) -> DataFrame:
    """Add a hashed share of payments sent again 1 to 120 seconds later, unchanged."""
    again = txn.where(draw("resend", "transaction_id") < share).withColumns(
        {
            "timestamp": F.timestamp_micros(
                F.unix_micros("timestamp")
                + whole("resend-gap", 1, 120, "transaction_id") * 1_000_000
            ),
            "transaction_id": F.concat("transaction_id", F.lit("-R")),
        }
    )
    return txn.unionByName(again)


def bank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the older bank table: a step counter, sticky city and phone per customer."""
    user = F.concat(F.lit("customer_"), zero_pad("user_id", 3))
    minutes = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - START_2024) / (10 * MINUTE))
    phone = F.col("_phone")
    written = F.concat(
        F.substring(phone, 1, 2),
        F.lit(" ("),
        F.substring(phone, 3, 3),
        F.lit(") "),
        F.substring(phone, 6, 3),
        F.lit("-"),
        F.substring(phone, 9, 4),
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("customer_id", user)
        .withColumn("_phone", phone_number("phone", "customer_id"))
        .select(
            "customer_id",
            F.concat("customer_id", F.lit("-"), zero_pad("event_id", 8)).alias("transaction_id"),
            minutes.cast("int").alias("step"),
            F.col("value").alias("amount"),
            pick(BANK_CITIES, "bank-city", "customer_id").alias("city"),
            account_number("account", "event_id").alias("receiver_account"),
            written.alias("receiver_phone"),
        )
    )


def expected_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phone number on file, which a tenth of the customers lack."""
    user = F.concat(F.lit("customer_"), zero_pad("user_id", 3)).alias("customer_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(user)
        .where(draw("enrolled", "customer_id") < 0.9)
        .withColumn("expected_phone", phone_number("phone", "customer_id"))
    )


def home_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's home city."""
    user = F.concat(F.lit("customer_"), zero_pad("user_id", 3)).alias("customer_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(user)
        .withColumn("home_city", home_city())
    )


def supplier_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as payments of the order's customer to the line's supplier, at the order's date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("customer_"), zero_pad("o_custkey", 3)).alias("customer_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("transaction_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        F.concat(F.lit("supplier_"), zero_pad("l_suppkey", 3)).alias("recipient_entity"),
    )


def customer_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
        F.concat(F.lit("customer_"), zero_pad("c_custkey", 3)).alias("customer_id"),
        F.col("n_name").alias("customer_country"),
    )


def supplier_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's country, and a later one for three in ten, which move on a drawn day."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    first = suppliers.withColumn("valid_from", F.lit("1900-01-01").cast("timestamp"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), whole("move-day", 0, 1000, "key"))
    later = suppliers.where(draw("moves", "key") < 0.3).select(
        "key",
        F.pmod(F.col("nation") + 1 + whole("move-to", 0, 23, "key"), F.lit(25)).alias("nation"),
        day.cast("timestamp").alias("valid_from"),
    )
    places, nations = first.unionByName(later), table(spark, sf_dir, "nation")
    return places.join(nations, places["nation"] == nations["n_nationkey"]).select(
        F.concat(F.lit("supplier_"), zero_pad("key", 3)).alias("recipient_entity"),
        F.col("n_name").alias("country"),
        "valid_from",
    )
