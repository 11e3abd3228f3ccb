"""Foreign recipients against a walk over the periods, with one recipient that half of all payments go to."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnlens.operators import foreign

TIME = "recipient_entity string, country string, valid_from timestamp"


def day(n):
    return datetime(2024, 1, n)


@pytest.mark.parametrize("join_rows", [10**6, 50])
def test_foreign_recipient(spark, payments, join_rows):
    rng = random.Random(2)
    names = ["shop"] * 6 + ["r1", "r2", "r3", "late", "nowhere"]
    rows = [(rng.choice("ABCD"), f"t{k}", f"2024-01-{rng.randint(1, 28):02d} 00:00:00", 1.0, rng.choice(names)) for k in range(1200)]
    rows.append(("A", "none", None, 1.0, "shop"))
    homes = {"A": "FR", "B": "DE", "C": None}
    history = [("shop", c, day(n)) for n, c in [(1, "FR"), (5, "DE"), (9, "FR"), (9, "XX"), (20, "IT")]]
    history += [("r1", "DE", day(1)), ("r2", "FR", day(3)), ("r3", None, day(1)), ("late", "DE", day(28))]
    got = foreign.foreign_recipient(
        payments(rows),
        spark.createDataFrame(list(homes.items()), "customer_id string, customer_country string"),
        spark.createDataFrame(history, TIME),
        join_rows,
    )

    def country(recipient, at):
        held = [(d, c) for r, c, d in history if r == recipient and at and d <= datetime.fromisoformat(at)]
        last = max((d for d, _ in held), default=None)
        return min((c for d, c in held if d == last and c), default=None)

    seen = {r.transaction_id: (r.customer_country, r.recipient_country, r.is_foreign_recipient) for r in got.collect()}
    assert len(seen) == len(rows) == got.count()
    for customer, id_, at, _, recipient in rows:
        home, there = homes.get(customer), country(recipient, at)
        assert seen[id_] == (home, there, int(bool(home and there and home != there)))


def test_a_merchant_with_half_of_all_payments_is_dealt_out(spark):
    txn = spark.range(40_000).select(
        F.lit("c").alias("customer_id"),
        F.col("id").cast("string").alias("transaction_id"),
        F.lit(day(2)).alias("timestamp"),
        F.when(F.col("id") % 2 == 0, "shop").otherwise(F.concat(F.lit("r"), "id")).alias("recipient_entity"),
    )
    assert [tuple(r) for r in foreign.salts(txn, 500).collect()] == [("shop", 40)]
    places = spark.createDataFrame([("shop", "FR", day(1))], TIME)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = foreign.recipient_country(txn, places, 500)
        tasks = [r["count"] for r in out.where("recipient_country = 'FR'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 20_000 and max(tasks) < 20_000 * 0.6
