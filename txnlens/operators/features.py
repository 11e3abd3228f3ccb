"""The row features of a payment: what it looks like against the customer's history.

A feature is made in two steps on rows prepared by ``by_customer``: aggregates over earlier rows
(``last_payment`` and its like), then columns from them (``gap_columns``). The order in ``history``
is a design rule: customer windows come first, so their one exchange by customer also serves the
windows by (customer, recipient), (customer, recipient, amount) and (customer, city).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.constants import FEATURES, FLAGS, LABEL
from txnlens.functions.calendar import MINUTE, SECOND, calendar_columns, seconds_since_midnight
from txnlens.operators.prefix import Earlier, before, moments_before, recent
from txnlens.operators.skew import CHUNK, CHUNK_ROWS, CROWDED_ROWS, by_customer
from txnlens.operators.spans import span_columns

RECIPIENT = ["customer_id", "recipient_entity"]


def _us() -> Column:
    return F.col("_us")


def last_payment() -> Earlier:
    return Earlier(["customer_id"], {"_last_us": ("max", _us())})


def recipient_payments() -> Earlier:
    return Earlier(
        RECIPIENT,
        {
            "_paid_before": ("count", F.lit(1)),
            "_first_us": ("min", _us()),
            "_sod": ("sum", seconds_since_midnight()),
        },
    )


def same_payments() -> Earlier:
    return Earlier([*RECIPIENT, "amount"], {"_last_same_us": ("max", _us())})


def city_payments() -> Earlier:
    return Earlier(["customer_id", "city"], {"_seen": ("count", F.lit(1))})


def gap_columns() -> dict[str, Column]:
    """Seconds since the customer's previous payment, -1 for the first."""
    gap = (_us() - F.col("_last_us")) / SECOND
    return {"time_since_last_txn": F.coalesce(gap, F.lit(-1.0))}


def recipient_columns() -> dict[str, Column]:
    """First payment to a recipient, and how far the time of day is from the usual one."""
    norm = F.try_divide(F.col("_sod"), F.col("_paid_before"))
    new = F.coalesce(_us() == F.col("_first_us"), F.lit(True))
    return {
        "is_new_recipient": new.cast("int"),
        "time_deviation_from_user_norm": F.abs(seconds_since_midnight() - norm),
    }


def duplicate_columns(minutes: float = 1) -> dict[str, Column]:
    """Flag a payment that repeats one of the last minutes: same recipient, same amount.

    Simultaneous payments are not flagged.
    """
    near = (_us() - F.col("_last_same_us")).between(1, int(minutes * MINUTE))
    return {
        "is_duplicate_transaction_within_X_minutes": F.coalesce(near, F.lit(False)).cast("int")
    }


def location_columns() -> dict[str, Column]:
    """Flag the customer's first payment in a city."""
    return {"is_unusual_location_for_user": (F.col("_seen") == 0).cast("int")}


def recipient_rolling(df: DataFrame, rows: int = 30, block_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean and sample deviation of the last ``rows`` earlier payments to the recipient.

    It needs ``_paid_before`` of ``recipient_payments``.
    """
    return recent(
        df,
        RECIPIENT,
        rows,
        "_paid_before",
        {
            "mean_amount_rolling": F.avg("amount"),
            "std_amount_rolling": F.stddev_samp("amount"),
        },
        block_rows,
    )


def deviation_columns() -> dict[str, Column]:
    """How many deviations the amount is off; 0 where that is undefined."""
    off = F.col("amount") - F.col("mean_amount_rolling")
    std = F.col("std_amount_rolling")
    return {
        "amount_deviation_rolling": F.coalesce(
            F.when(std > 0, F.try_divide(off, std)), F.lit(0.0)
        )
    }


def usual_amounts(df: DataFrame) -> DataFrame:
    """How many deviations the amount is off what the customer paid before in this category, and at this hour.

    0 where that is undefined: up to one earlier payment, or equal ones.
    """
    kinds = {"category": ["customer_id", "entity_type"], "hour": ["customer_id", "_hour"]}
    df = moments_before(df.withColumn("_hour", F.hour("timestamp")), "amount", kinds)
    columns = {}
    for name in kinds:
        n, mean, squares = (F.col(f"{part}_{name}") for part in ("_n", "_mean", "_squares"))
        std = F.sqrt(F.try_divide(squares, (n - 1).cast("double")))
        off = F.when((n > 1) & (std > 0), F.try_divide(F.col("amount") - mean, std))
        columns[f"amount_deviation_{name}"] = F.coalesce(off, F.lit(0.0))
    return df.withColumns(columns)


# Halves a payment's part in what is habitual.
HALF_LIFE_DAYS = 30


def habitual_place(df: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """The share of the payment's city among the customer's earlier payments, older ones counting less.

    A payment counts half as much after each half-life. Weights are powers of 2 from the year 2000 on, which
    cancel out in the share; doubles hold 1,000 half-lives each way. Null without earlier payments.
    """
    since = _us() - 946_684_800_000_000
    weight = F.pow(F.lit(2.0), since / (half_life_days * 86_400_000_000))
    df = before(
        df,
        Earlier(["customer_id"], {"_all_weight": ("sum", weight)}),
        Earlier(["customer_id", "city"], {"_city_weight": ("sum", weight)}),
    )
    share = F.try_divide(F.coalesce("_city_weight", F.lit(0.0)), F.col("_all_weight"))
    return df.withColumn("habitual_place_share", share)


def target_label(df: DataFrame) -> DataFrame:
    """1 if any kind of accident is flagged."""
    return df.withColumn(
        LABEL, F.greatest(*[F.coalesce(F.col(flag).cast("int"), F.lit(0)) for flag in FLAGS])
    )


def add_features(
    txn: DataFrame,
    duplicate_minutes: float = 1,
    crowded_rows: int = CROWDED_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """All features and the label in one table: one row per transaction, as many as came in.

    Training and scoring both call this, so a feature cannot mean two things.
    """

    others = [recipient_payments(), same_payments(), city_payments()]

    def history(rows: DataFrame) -> DataFrame:
        if CHUNK in rows.columns:
            df = span_columns(before(rows, last_payment(), *others), base=rows)
        else:
            # The spans come second: they use the sort order of the customer's payments.
            df = before(span_columns(before(rows, last_payment())), *others)
        return recipient_rolling(df, block_rows=chunk_rows).withColumns(
            gap_columns()
            | recipient_columns()
            | duplicate_columns(duplicate_minutes)
            | location_columns()
            | deviation_columns()
        )

    featured = by_customer(txn, history, crowded_rows, chunk_rows)
    featured = target_label(featured.withColumns(calendar_columns()))
    kept = [c for c in txn.columns if c not in FEATURES]
    return featured.select(*kept, *FEATURES, LABEL)
