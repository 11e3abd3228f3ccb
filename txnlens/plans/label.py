"""Write labelled payments: ``spark-submit txnlens/plans/label.py IN OUT``.

Without more, bursts, high amounts and mistyped recipients are put into the payments: ``OUT/payments`` has
all of them with their flags and the label, ``OUT/mistyped`` what recipients were meant. With
``--expected PHONES`` (a CSV of customer_id and expected_phone) places and phones are changed instead and
payments are labelled by rules: ``OUT/payments`` has the rules that hit, ``OUT/counts`` how often.

Both are published by manifest, so a job that dies leaves the last result as it was.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from txnlens.constants import BANK_CITIES
from txnlens.operators import features, inject, labels, profile
from txnlens.operators.skew import stage
from txnlens.session import job_session
from txnlens.sources.csv import read_raw
from txnlens.sources.files import add_input_options, load
from txnlens.sources.publish import publish


def by_accidents(txn: DataFrame) -> dict[str, DataFrame]:
    """Payments with accidents put in, and the recipients that were mistyped; written once."""
    labelled = stage(features.target_label(inject.inject_accidents(txn)), "labelled")
    typos = profile.filter_accidents(labelled, "is_mistyped_entity_accident")
    mistyped = typos.select(
        "customer_id",
        "transaction_id",
        "timestamp",
        "transaction_type",
        "amount",
        "original_recipient_entity",
        "recipient_entity",
    )
    return {"payments": labelled, "mistyped": mistyped}


def by_rules(txn: DataFrame, expected: DataFrame, times: float = 5) -> dict[str, DataFrame]:
    """Payments with places and phones changed, labelled by rules, and how often each rule hits; written once.

    The payments need ``city`` and ``receiver_phone``.
    """
    changed = inject.inject_phones(inject.inject_locations(txn, BANK_CITIES), base=txn)
    labelled = stage(labels.rule_label(changed, expected, times, txn), "labelled")
    return {"payments": labelled, "counts": labels.rule_counts(labelled)}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    add_input_options(parser)
    parser.add_argument("--expected", help="CSV of customer_id and expected_phone")
    parser.add_argument("--times", type=float, default=5, help="an amount above so many means is an accident")
    parser.add_argument("--output-format", choices=["csv", "json", "parquet"], default="csv")
    parser.add_argument("--by-day", action="store_true", help="CSV of payments in folders by day")
    args = parser.parse_args()
    spark = job_session("txnlens-label")
    txn = load(spark, args.input, args.format, not args.lenient, args.timestamp_format)
    if args.expected:
        phones = read_raw(spark, args.expected).select("customer_id", "expected_phone")
        tables = by_rules(txn, phones, args.times)
    else:
        tables = by_accidents(txn)
    for name, table in tables.items():
        days = args.by_day and "timestamp" in table.columns
        manifest = publish(table, f"{args.output.rstrip('/')}/{name}", args.output_format, days)
        print(f"{name}: {manifest.rows} rows in {len(manifest.files)} files")


if __name__ == "__main__":
    main()
