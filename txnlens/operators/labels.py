"""Rule labels, burst groups and mistyped recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.calendar import SECOND
from txnlens.functions.text import differs, is_digits, normalize_phone
from txnlens.operators.joins import group_mean, join_by_key, lookup
from txnlens.operators.prefix import Earlier, before
from txnlens.operators.skew import CHUNK_ROWS, CROWDED_ROWS, by_customer, stage


def above_mean(times: float) -> Column:
    """The amount is above so many times the customer's mean, given as ``mean_amount``."""
    return F.coalesce(F.col("amount") > F.lit(float(times)) * F.col("mean_amount"), F.lit(False))


def phones_differ() -> Column:
    """Receiver's phone against the expected one, both normalised; a missing one differs."""
    return differs(normalize_phone("receiver_phone"), normalize_phone("expected_phone"))


def phone_mismatch(
    df: DataFrame, expected: DataFrame, base: DataFrame | None = None
) -> DataFrame:
    """Compare the receiver's phone with the customer's expected one."""
    joined = lookup(df, expected, "customer_id", base)
    return joined.withColumn("is_phone_mismatch", phones_differ())


def rule_label(
    df: DataFrame, expected: DataFrame, times: float = 5, base: DataFrame | None = None
) -> DataFrame:
    """Label by rules: unusual amount, wrong phone or unusual place.

    What is known of a customer, mean amount and expected phone, comes in one join. Means are
    taken from ``base``, the same rows before further work.
    """
    facts = group_mean(base or df).join(expected, "customer_id", "left")
    checked = join_by_key(df, facts, "customer_id", "_rows").withColumns(
        {"is_high_amount": above_mean(times), "is_phone_mismatch": phones_differ()}
    )
    accident = (
        F.col("is_high_amount") | F.col("is_phone_mismatch") | F.col("is_location_anomaly")
    )
    return checked.withColumn("is_accident", accident)


def rule_counts(labelled: DataFrame) -> DataFrame:
    """How many rows each rule hits, and how many any."""
    return labelled.agg(
        F.count_if("is_high_amount").alias("high_amount"),
        F.count_if("is_location_anomaly").alias("location"),
        F.count_if("is_phone_mismatch").alias("phone"),
        F.count_if("is_accident").alias("accidents"),
        F.count(F.lit(1)).alias("rows"),
    )


def burst_groups(
    txn: DataFrame,
    gap_seconds: float = 5,
    crowded_rows: int = CROWDED_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs of payments of one customer with at most ``gap_seconds`` between neighbours."""

    def starts(rows: DataFrame) -> DataFrame:
        df = before(rows, Earlier(["customer_id"], {"_last_us": ("max", F.col("_us"))}))
        apart = F.col("_us") - F.col("_last_us") > int(gap_seconds * SECOND)
        begins = F.coalesce(apart, F.lit(True))
        df = df.withColumn("_begins_us", F.when(begins, F.col("_us")))
        begun = Earlier(["customer_id"], {"_begun_us": ("max", F.col("_begins_us"))})
        return before(df, begun).withColumn("_group_us", F.coalesce("_begins_us", "_begun_us"))

    return (
        by_customer(
            txn.select("customer_id", "transaction_id", "timestamp", "amount"),
            starts,
            crowded_rows,
            chunk_rows,
        )
        .groupBy("customer_id", F.timestamp_micros("_group_us").alias("started_at"))
        .agg(
            F.max("timestamp").alias("ended_at"),
            F.count(F.lit(1)).alias("payments"),
            F.sum("amount").alias("total_amount"),
        )
        .where("payments > 1")
    )


def typo_candidates(txn: DataFrame) -> DataFrame:
    """Account numbers that differ from one the customer used earlier in one or two digits.

    Every number is written with each pair of its digits masked, and numbers are paired on equal
    masked forms. Two numbers of equal length share a masked form only if they differ in those
    two digits at most, so nothing is paired in vain: the work grows with the pairs that are
    reported and no group of a customer's recipients is multiplied out.
    """
    accounts = (
        txn.where(is_digits("recipient_entity"))
        .groupBy("customer_id", "recipient_entity")
        .agg(F.min("timestamp").alias("first_seen"), F.count(F.lit(1)).alias("payments"))
    )
    accounts = stage(accounts, "accounts")  # paired with itself: summed up once, read twice
    length = F.length("recipient_entity")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), length - 1),
            lambda i: F.transform(
                F.sequence(i + 1, length), lambda j: F.struct(i.alias("i"), j.alias("j"))
            ),
        )
    )
    masked = (
        accounts.where(length > 1)
        .select("*", F.inline(pairs))
        .withColumn(
            "mask",
            F.overlay(
                F.overlay(F.col("recipient_entity"), F.lit("*"), F.col("i"), F.lit(1)),
                F.lit("*"),
                F.col("j"),
                F.lit(1),
            ),
        )
    )
    old, new = masked.alias("old"), masked.alias("new")
    matched = old.join(
        new,
        (F.col("old.customer_id") == F.col("new.customer_id"))
        & (F.col("old.mask") == F.col("new.mask"))
        & (F.col("old.first_seen") < F.col("new.first_seen")),
    )

    def same_digit(at: str) -> Column:
        return F.substring(F.col("old.recipient_entity"), F.col(at), F.lit(1)) == F.substring(
            F.col("new.recipient_entity"), F.col(at), F.lit(1)
        )

    # Numbers that differ in one digit meet under every mask that covers it; the mask with the
    # first other digit is kept.
    differ_i, differ_j = ~same_digit("new.i"), ~same_digit("new.j")
    first = F.col("new.i") == 1
    first_mask = (
        F.when(differ_i & differ_j, True)
        .when(differ_j, first)
        .otherwise(first & (F.col("new.j") == 2))
    )
    return matched.where(first_mask).select(
        F.col("new.customer_id").alias("customer_id"),
        F.col("new.recipient_entity").alias("recipient_entity"),
        F.col("old.recipient_entity").alias("likely_recipient"),
        F.col("new.first_seen").alias("first_seen"),
        F.col("old.first_seen").alias("likely_first_seen"),
        (differ_i.cast("int") + differ_j.cast("int")).alias("digits_off"),
        F.col("new.payments").alias("payments"),
        F.col("old.payments").alias("likely_payments"),
    )


def shortened(text: Column) -> Column:
    """The text and all that is left of it after one or two characters have gone."""
    length = F.length(text)

    def without(i: Column, of: Column = text) -> Column:
        return F.concat(F.substring(of, F.lit(1), i - 1), F.substring(of, i + 1, length))

    one = F.transform(F.sequence(F.lit(1), length), without)
    # the later of two places goes first, so the earlier one keeps its number
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(2), length),
            lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: without(i, without(j))),
        )
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(F.array(text), F.when(length > 0, one).otherwise(none), F.when(length > 1, two).otherwise(none))
    )


def edited_accounts(txn: DataFrame, edits: int = 2) -> DataFrame:
    """Account numbers within two edits of one that the customer used earlier.

    An edit puts in, takes out or changes a digit. Two numbers that are at most two edits apart have a form
    in common after up to two digits of each have gone, so every number is written once under the hash
    of each such form and numbers are paired where they meet, which is then verified. A form of k digits
    has at most 100 (k + 2)(k + 1) / 2 numbers of k + 2 digits, so groups are bounded by the length of account
    numbers, not by the data. Of two numbers first seen at the same time the one in the payment with the
    smaller id is the earlier one.
    """
    if not 1 <= edits <= 2:
        raise ValueError("edits must be 1 or 2")
    seen = F.struct(F.col("timestamp").alias("at"), F.col("transaction_id").alias("id"))
    accounts = (
        txn.where(is_digits("recipient_entity"))
        .groupBy("customer_id", F.col("recipient_entity").alias("number"))
        .agg(F.min(seen).alias("first"), F.count(F.lit(1)).alias("payments"))
    )
    forms = F.transform(shortened(F.col("number")), lambda form: F.xxhash64(form))
    met = (
        accounts.select("customer_id", F.explode(forms).alias("form"), F.struct("first", "number", "payments").alias("account"))
        .groupBy("customer_id", "form")
        .agg(F.collect_list("account").alias("accounts"))
        .where(F.size("accounts") > 1)
    )

    def earlier(new: Column) -> Column:
        """The accounts met that are older and near, each with this one."""
        near = F.filter(
            "accounts",
            lambda old: (old["first"] < new["first"]) & (F.levenshtein(old["number"], new["number"], edits) >= 0),
        )
        return F.transform(near, lambda old: F.struct(new.alias("new"), old.alias("old")))

    pairs = met.select("customer_id", F.inline(F.flatten(F.transform("accounts", earlier))))
    # pairs meet under several forms
    return pairs.distinct().select(
        "customer_id",
        F.col("new.number").alias("recipient_entity"),
        F.col("old.number").alias("likely_recipient"),
        F.col("new.first.at").alias("first_seen"),
        F.col("old.first.at").alias("likely_first_seen"),
        F.levenshtein("old.number", "new.number").alias("edits"),
        F.col("new.payments").alias("payments"),
        F.col("old.payments").alias("likely_payments"),
    )
